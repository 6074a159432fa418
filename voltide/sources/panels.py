"""Panels of series: one long frame (series, dt, px) derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltide.sources.store import written


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, unit: str = "day", by: str = "p_brand") -> DataFrame:
    """series (brand), dt (the day, or the Monday of the week), price and quantity of each line item,
    and the item's place in its order."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    brands = read(spark, sf_dir, "part").select("p_partkey", by)
    return items.join(brands, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col(by).alias("series"),
        F.date_trunc(unit, "l_shipdate").cast("date").alias("dt"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.struct("l_orderkey", "l_linenumber").alias("place"),
    )


def totals(spark: SparkSession, sf_dir: str, unit: str = "day", by: str = "p_brand") -> DataFrame:
    """series, dt, price, qty: what was sold of each series and date, written. Panels read their sales
    many times; the line items are read and joined once, here."""
    return written(sales(spark, sf_dir, unit, by).groupBy("series", "dt").agg(F.sum("price").alias("price"), F.sum("qty").alias("qty")))


def observed(sold: DataFrame) -> DataFrame:
    """Quantity-weighted price per series and date, where there were sales, from `totals`."""
    return sold.select("series", "dt", (F.col("price") / F.col("qty")).alias("px"))


def calendar(seen: DataFrame) -> DataFrame:
    """dt, i: the dates in order, numbered from 1. A window without partition, over dates alone: a
    calendar has some 260 rows a year, whatever the data."""
    return seen.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")))


def dense(seen: DataFrame) -> DataFrame:
    """Every series on the union calendar, the last value carried forward. The grid is the product of
    the series and the dates: as many rows as the panel has."""
    grid = seen.select("series").distinct().crossJoin(F.broadcast(calendar(seen)))
    w = Window.partitionBy("series").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(seen, ["series", "dt"], "left").select("series", "dt", "i", F.last("px", ignorenulls=True).over(w).alias("px"))


def prices(spark: SparkSession, sf_dir: str, unit: str = "day", sold: DataFrame | None = None) -> DataFrame:
    """The dense panel; `sold` is what `totals` gave, where other steps of the query read it too."""
    return dense(observed(totals(spark, sf_dir, unit) if sold is None else sold))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel without values carried forward: dates without sales are missing."""
    seen = observed(totals(spark, sf_dir))
    return seen.join(calendar(seen), "dt").select("series", "dt", "i", "px")


def market(spark: SparkSession, sf_dir: str, unit: str = "day", sold: DataFrame | None = None) -> DataFrame:
    """Log-returns (x100) of the price over all series, nulls dropped: each date joined with the one
    before it in the calendar. `sold` as for `prices`."""
    sold = totals(spark, sf_dir, unit) if sold is None else sold
    by = sold.groupBy("dt").agg((F.sum("price") / F.sum("qty")).alias("px"))
    by = by.join(calendar(by), "dt")
    before = by.select((F.col("i") + 1).alias("i"), F.col("px").alias("was"))
    return by.join(before, "i").select("dt", (100 * F.log(F.col("px") / F.col("was"))).alias("Market_Returns")).where("Market_Returns is not null")


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each series from the unit prices of its items, in the order of their orders; the
    adjusted close is the quantity-weighted price."""
    unit = F.col("price") / F.col("qty")
    return sales(spark, sf_dir).groupBy("series", F.col("dt").alias("Date")).agg(
        (F.sum("price") / F.sum("qty")).alias("Adj Close"),
        F.max_by(unit, "place").alias("Close"),
        F.max(unit).alias("High"),
        F.min(unit).alias("Low"),
        F.min_by(unit, "place").alias("Open"),
        F.sum("qty").cast("long").alias("Volume"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic table of fold metrics: Category, Ticker, Model, Fold and six scores."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.concat(F.lit(" [k="), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("]"))
    line = F.col("l_linenumber") % 4
    category = F.when(line == 0, F.lit("HAR")).when(line == 1, F.concat(F.lit("Network"), k)).when(line == 2, F.concat(F.lit("PCorr Network"), k)).otherwise(F.concat(F.lit("MI Network"), k))
    d = lambda c: F.col(c).cast("double")
    return items.groupBy(
        category.alias("Category"),
        F.col("p_brand").alias("Ticker"),
        F.concat(F.lit("M-"), "l_returnflag", "l_linestatus").alias("Model"),
        (F.month("l_shipdate") % 2).cast("int").alias("Fold"),
    ).agg(
        F.stddev_pop(F.log(d("l_extendedprice"))).alias("RMSE_log"),
        (F.avg(d("l_discount")) * 12 - 0.3).alias("R2_log"),
        F.stddev_pop(d("l_quantity")).alias("RMSE"),
        (F.avg(d("l_tax")) * 12 - 0.3).alias("R2"),
        F.avg(d("l_quantity")).alias("MAE"),
    )


def spike_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic table of classification metrics over the same cells as `metrics`; ROC_AUC is
    null where a cell has one row."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.concat(F.lit(" [k="), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("]"))
    line = F.col("l_linenumber") % 4
    category = F.when(line == 0, F.lit("HAR-Logit")).when(line == 1, F.concat(F.lit("ExpKernel Network"), k)).when(line == 2, F.concat(F.lit("PCorr Network"), k)).otherwise(F.concat(F.lit("Network+Clustering"), k))
    d = lambda c: F.col(c).cast("double")
    return items.groupBy(
        category.alias("Category"),
        F.col("p_brand").alias("Ticker"),
        F.concat(F.lit("C-"), "l_returnflag", "l_linestatus").alias("Model"),
        (F.month("l_shipdate") % 2).cast("int").alias("Fold"),
    ).agg(
        F.when(F.count(F.lit(1)) > 1, F.avg(d("l_discount")) * 10).alias("ROC_AUC"),
        (F.avg(d("l_tax")) * 12).alias("F1"),
        (F.avg(d("l_quantity")) / 50).alias("Recall"),
        F.avg(d("l_discount") * 8).alias("Precision"),
        F.avg(d("l_tax") * 10).alias("Accuracy"),
        F.stddev_pop(d("l_quantity")).alias("Weighted_Recall"),
    )


def realised(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """series (event type), dt (hour, or day), rv, r, closeprice: squared log changes, log change and last
    value inside each; values that are not positive are left out."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.date_trunc(unit, "ts").alias("dt"), "ts", "event_id", F.col("value").cast("double").alias("v")).where("v > 0")
    w = Window.partitionBy("series", "dt").orderBy("ts", "event_id")
    e = e.withColumn("step", F.log("v") - F.log(F.lag("v").over(w)))
    at = F.struct("ts", "event_id")
    return e.groupBy("series", "dt").agg(F.sum(F.col("step") ** 2).alias("rv"), F.log(F.max_by("v", at) / F.min_by("v", at)).alias("r"), F.max_by("v", at).alias("closeprice"))
