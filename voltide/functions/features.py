"""Variance features, targets and labels of a panel; one window per series serves them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.quantiles import quantiles

EPS = 1e-8


def _w(a: int, b: int):
    return Window.partitionBy("series").orderBy("dt").rowsBetween(a, b)


def _full(agg: Column, x: Column, n: int, a: int, b: int) -> Column:
    """`agg` over the frame, null unless all its `n` values are there."""
    return F.when(F.count(x).over(_w(a, b)) == n, agg.over(_w(a, b)))


def returns(panel: DataFrame, lags: tuple[int, ...] = ()) -> DataFrame:
    w = Window.partitionBy("series").orderBy("dt")
    out = panel.withColumn("Returns", 100 * F.log(F.col("px") / F.lag("px").over(w)))
    for n in lags:
        out = out.withColumn(f"Returns_Lag_{n}", 100 * F.log(F.col("px") / F.lag("px", n).over(w)))
    return out


def variance_features(df: DataFrame, horizon: int = 5, eps: float = EPS) -> DataFrame:
    """RV1/5/10/22, semivariances, the forward target and the logs of them all."""
    r2 = F.col("Returns") * F.col("Returns")
    down = F.when(F.col("Returns") < 0, r2).otherwise(0.0)
    up = F.when(F.col("Returns") > 0, r2).otherwise(0.0)
    df = df.withColumn("RV1", r2)
    for n in (5, 10, 22):
        df = df.withColumn(f"RV{n}", _full(F.avg("RV1"), F.col("RV1"), n, -(n - 1), 0))
    df = df.withColumn("neg_semi_var5", _full(F.avg(down), down, 5, -4, 0)).withColumn("pos_semi_var5", _full(F.avg(up), up, 5, -4, 0))
    df = df.withColumn("Y_fwd", _full(F.sum("RV1"), F.col("RV1"), horizon, 1, horizon))
    logs = {"log_RV1": "RV1", "log_RV5": "RV5", "log_RV10": "RV10", "log_RV22": "RV22", "log_neg_semi5": "neg_semi_var5", "log_pos_semi5": "pos_semi_var5", "log_Y": "Y_fwd"}
    return df.withColumns({k: F.log(F.col(v) + eps) for k, v in logs.items()})


def market_features(df: DataFrame, market: DataFrame, eps: float = EPS) -> DataFrame:
    """Market returns by date; their 5 and 22 row variances over each series' own rows."""
    df = df.join(market, "dt", "left").withColumn("m2", F.col("Market_Returns") ** 2)
    for n in (5, 22):
        df = df.withColumn(f"Market_RV{n}", _full(F.avg("m2"), F.col("m2"), n, -(n - 1), 0)).withColumn(f"log_Market_RV{n}", F.log(F.col(f"Market_RV{n}") + eps))
    return df.drop("m2")


def remove_outliers(df: DataFrame, columns: list[str], keys: list[str], limit: float = 3.0) -> DataFrame:
    """Rows with |z| < limit in all columns; a missing value removes the row, a zero spread does not."""
    w = Window.partitionBy(*keys)
    keep = F.lit(True)
    for c in columns:
        sd = F.stddev_samp(c).over(w)
        z = F.when(sd == 0, 0.0).otherwise(F.abs((F.col(c) - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0))))
        keep = keep & F.coalesce(z < limit, F.lit(False))
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def spike_labels(df: DataFrame, quantile: float = 0.8, lookback: int | None = None) -> DataFrame:
    """Per series the exact quantile of Y_fwd (of its last `lookback` rows) and y > threshold."""
    rows = df.where("Y_fwd is not null")
    if lookback:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("dt")))).where(F.col("_n") <= lookback)
    limit = quantiles(rows, ["series"], "Y_fwd", [quantile]).select("series", F.col("q")[0].alias("threshold"))
    return df.join(limit, "series").withColumn("spike", (F.col("Y_fwd") > F.col("threshold")).cast("int"))


def folds(df: DataFrame, n_splits: int = 1, test: int = 252, min_train: int = 1260) -> DataFrame:
    """Expanding folds counted back from the end, 0 the latest: adds fold and role (train, test)."""
    w = Window.partitionBy("series")
    rows = df.withColumn("_i", F.row_number().over(w.orderBy("dt"))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= min_train + test)
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    end = F.col("_n") - F.col("fold") * test
    rows = rows.where((end - test >= min_train) & (F.col("_i") <= end))
    return rows.withColumn("role", F.when(F.col("_i") > end - test, "test").otherwise("train")).drop("_i", "_n")


def standardise(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns by the mean and the population deviation (0 counts as 1) of the key's training rows."""
    train = F.col("role") == "train"
    stats = df.where(train).groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(stats, keys)
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(scaled).select(df.columns)


def fill_and_keep(df: DataFrame, columns: list[str], least: int = 300) -> DataFrame:
    """Last known values carried forward, rows still missing one dropped, series with `least` rows
    or more before and after kept."""
    w = Window.partitionBy("series")
    past = w.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns}).dropna(subset=columns)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_n")


def realised_features(df: DataFrame, horizon: int = 5, eps: float = EPS) -> DataFrame:
    """The variance features of series whose variance `rv` is measured: rv takes the place of the
    squared return (on days of a falling or of no falling price in the semivariances), and the target
    is the sum of future rv."""
    down, up = F.when(F.col("r") < 0, F.col("rv")).otherwise(0.0), F.when(F.col("r") >= 0, F.col("rv")).otherwise(0.0)
    df = df.withColumn("Returns", 100 * F.col("r")).withColumn("RV1", F.col("rv"))
    for n in (5, 10, 22):
        df = df.withColumn(f"RV{n}", _full(F.avg("RV1"), F.col("RV1"), n, -(n - 1), 0))
    df = df.withColumn("neg_semi_var5", _full(F.avg(down), down, 5, -4, 0)).withColumn("pos_semi_var5", _full(F.avg(up), up, 5, -4, 0))
    df = df.withColumn("Y_fwd", _full(F.sum("RV1"), F.col("RV1"), horizon, 1, horizon))
    logs = {"log_RV1": "RV1", "log_RV5": "RV5", "log_RV10": "RV10", "log_RV22": "RV22", "log_neg_semi5": "neg_semi_var5", "log_pos_semi5": "pos_semi_var5", "log_Y": "Y_fwd"}
    return df.withColumns({k: F.log(F.col(v) + eps) for k, v in logs.items()})


def realised_market(df: DataFrame, market: DataFrame, eps: float = EPS) -> DataFrame:
    """Market features from the proxy's own measured variance: `market` has dt, rv and r. Both windows
    run over each series' own rows."""
    proxy = market.select("dt", (100 * F.col("r")).alias("Market_Returns"), F.col("rv").alias("m2"))
    df = df.join(proxy, "dt", "left")
    for n in (5, 22):
        df = df.withColumn(f"Market_RV{n}", _full(F.avg("m2"), F.col("m2"), n, -(n - 1), 0)).withColumn(f"log_Market_RV{n}", F.log(F.col(f"Market_RV{n}") + eps))
    return df.drop("m2")


HAR_COLUMNS = ["log_RV1", "log_RV5", "log_RV10", "log_RV22", "log_neg_semi5", "log_pos_semi5", "Returns", "log_Y", "Y_fwd"]


def har_panel(panel: DataFrame, market: DataFrame | None = None, least: int = 2) -> DataFrame:
    """The features of a panel of prices with those of the market, complete rows only, of the series
    that keep `least` of them or more."""
    rows = variance_features(returns(panel))
    needed = list(HAR_COLUMNS)
    if market is not None:
        rows = market_features(rows, market)
        needed += ["Market_Returns", "log_Market_RV5", "log_Market_RV22"]
    rows = rows.dropna(subset=needed)
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series"))).where(F.col("_n") >= least).drop("_n")


def preprocess(panel: DataFrame, lags: tuple[int, ...], own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Returns over the lags, then a function of the caller's from panel to panel."""
    return returns(panel, lags).transform(own)
