"""Exploratory statistics of a panel's returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.quantiles import quantiles


def numbered(df: DataFrame, days: int = 256) -> DataFrame:
    """The rows with `j`, their number in their series by date, from 1. Rows are numbered inside blocks of
    `days` days; a table of the blocks' counts says where each begins, so no task sorts a series."""
    rows = df.withColumn("_block", F.floor(F.unix_date("dt") / days))
    before = Window.partitionBy("series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("series", "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("series", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("series", "_block").orderBy("dt"))
    return rows.withColumn("_place", place).join(starts, ["series", "_block"]).withColumn("j", F.col("_start") + F.col("_place")).drop("_block", "_place", "_start")


def autocorrelation(df: DataFrame, column: str = "Returns", lags: int = 10, size: int = 512) -> DataFrame:
    """series, lag, acf, band: correlations with the value `lag` rows before, and 1.96 / sqrt(n).

    A series is cut into blocks of `size` rows, each with the `lags` rows before it, so a row is sent once
    or twice whatever the number of lags, and the products of all lags are added up in one pass."""
    size = max(size, lags)
    rows = numbered(df.where(F.col(column).isNotNull()).select("series", "dt", F.col(column).alias("x")))
    total = rows.groupBy("series").agg(F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    own = F.floor((F.col("j") - 1) / size)
    reach = F.array_distinct(F.array(own, F.floor((F.col("j") - 1 + lags) / size)))
    parts = rows.join(total, "series").select("series", F.explode(reach).alias("part"), own.alias("own"), "j", (F.col("x") - F.col("mean")).alias("x"))
    w = Window.partitionBy("series", "part").orderBy("j")
    parts = parts.select("series", (F.col("own") == F.col("part")).alias("here"), "x", *(F.lag("x", n).over(w).alias(f"x{n}") for n in range(1, lags + 1)))
    sums = parts.where("here").groupBy("series").agg(*(F.sum(F.col("x") * F.col(f"x{n}")).alias(f"s{n}") for n in range(1, lags + 1)))
    found = sums.select("series", F.posexplode(F.array(*(f"s{n}" for n in range(1, lags + 1)))).alias("lag", "s")).where("s is not null")
    return found.join(total, "series").select("series", (F.col("lag") + 1).alias("lag"), F.try_divide("s", "ss").alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def distribution(df: DataFrame, column: str = "Returns") -> DataFrame:
    """n, mean, std, bias-corrected skewness and excess kurtosis per series."""
    x, n = F.col(column), F.count(column)
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    kurt = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6)
    return df.where(x.isNotNull()).groupBy("series").agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), skew.alias("skew"), kurt.alias("kurtosis"))


def tail_outliers(df: DataFrame, column: str = "Returns", tail: float = 0.01) -> DataFrame:
    """Quantile cutoffs per series and how many values are at or beyond them."""
    cut = quantiles(df, ["series"], column, [tail, 1 - tail]).select("series", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return df.where(F.col(column).isNotNull()).join(cut, "series").groupBy("series").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.count_if(F.col(column) <= F.col("low")).alias("n_low"), F.count_if(F.col(column) >= F.col("high")).alias("n_high"), F.count(F.lit(1)).alias("n"))


def normalised(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select("series", "dt", (100 * F.col("px") / F.first("px", ignorenulls=True).over(w)).alias("index"))


def histogram(panel: DataFrame, bins: int = 20, tail: float = 0.01) -> DataFrame:
    """bin (from 1), n and density of the pooled returns between two quantiles, both included."""
    r = panel.where("Returns is not null").select("Returns")
    ends = quantiles(r, [], "Returns", [tail, 1 - tail]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("Returns") - F.col("lo")) / width) + 1, F.lit(bins))
    rows = r.join(F.broadcast(ends)).where("Returns between lo and hi").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(width).alias("width"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows from `start` to `end`, both included; an end that is None is open."""
    out = df if start is None else df.where(F.col("dt") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("dt") <= F.lit(end).cast("date"))


def common_autocorrelation(df: DataFrame, column: str = "Returns", lags: int = 10) -> DataFrame:
    """Autocorrelations of all series up to the lag that the shortest one allows, with its band."""
    shortest = df.where(F.col(column).isNotNull()).groupBy("series").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    out = autocorrelation(df, column, lags).drop("band").join(F.broadcast(shortest))
    return out.where(F.col("lag") < F.col("n")).select("series", "lag", "acf", (1.96 / F.sqrt("n")).alias("band"))


def sigma_outliers(df: DataFrame, column: str = "Returns", z: float = 3.0) -> DataFrame:
    """Cutoffs at mean -+ z deviations per series, how many values are at or beyond them, and their
    share."""
    x = F.col(column)
    rows = df.where(x.isNotNull())
    cut = rows.groupBy("series").agg((F.avg(x) - z * F.stddev_samp(x)).alias("low"), (F.avg(x) + z * F.stddev_samp(x)).alias("high"))
    out = rows.join(cut, "series").groupBy("series", "low", "high").agg(F.count_if(x <= F.col("low")).alias("n_low"), F.count_if(x >= F.col("high")).alias("n_high"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", (F.col("n_low") + F.col("n_high")) / F.col("n"))
