"""File formats: universe lists, price files, wide tables of realised measures, feature stores,
result tables, and exports of graphs and features. All are read and written by Spark's own readers
and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.sources.store import exists

BARS = "Date DATE, `Adj Close` DOUBLE, Close DOUBLE, High DOUBLE, Low DOUBLE, Open DOUBLE, Volume BIGINT"
REGRESSION = "Category STRING, Ticker STRING, Model STRING, Fold INT, R2 DOUBLE, RMSE DOUBLE, MAE DOUBLE, R2_log DOUBLE, RMSE_log DOUBLE, MAE_log DOUBLE"
SPIKES = "Category STRING, Ticker STRING, Model STRING, Fold INT, F1 DOUBLE, Precision DOUBLE, Recall DOUBLE, ROC_AUC DOUBLE, Weighted_Recall DOUBLE, Accuracy DOUBLE"


def write_universe(ranked: DataFrame, path: str) -> None:
    """rank, company, symbol as a tab-separated text with two header lines. One file: the list of a
    universe has some hundred lines."""
    line = F.concat_ws("\t", F.col("rank").cast("string"), "company", "symbol", F.lit("0.1%"), F.lit("1.0"), F.lit("0.0"), F.lit("(0.00%)"))
    heads = ranked.sparkSession.createDataFrame([(-1, "Universe"), (0, "#\tCompany\tSymbol\tWeight\tPrice\tChg\t% Chg")], "rank long, value string")
    rows = heads.unionByName(ranked.select(F.col("rank").cast("long").alias("rank"), line.alias("value")))
    rows.coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)


def universe(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """rank, company, symbol of the first `n` lines that start with a number."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d+\t")).select(parts[0].cast("int").alias("rank"), parts[1].alias("company"), parts[2].alias("symbol"))
    return rows if n is None else rows.where(F.col("rank") <= n)


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder of CSV files for each series; a series' years are written by tasks of their own."""
    bars.repartition("series", F.year("Date")).write.partitionBy("series").option("header", True).csv(path)


def bars(spark: SparkSession, path: str) -> DataFrame:
    """series, from a file's folder or name, and its daily bars; values that are no numbers are null."""
    file = F.url_decode(F.url_decode(F.col("_metadata.file_path")))
    series = F.coalesce(F.nullif(F.regexp_extract(file, r"series=([^/]+)/", 1), F.lit("")), F.regexp_extract(file, r"([^/]+)\.csv$", 1))
    return spark.read.schema(BARS).option("header", True).option("recursiveFileLookup", True).csv(path).select(series.alias("series"), "*")


def price_panel(found: DataFrame) -> DataFrame:
    return found.select("series", F.col("Date").alias("dt"), F.col("Adj Close").alias("px"))


def write_wide(measures: DataFrame, path: str, names: list[str]) -> None:
    """series, dt, rv, r, closeprice of the named series as one wide table with three header lines,
    the last of which has the codes. One file, a line for each date."""
    columns = ["rv", "r", "closeprice"]
    wide = measures.groupBy("dt").pivot("series", names).agg(*(F.first(c).alias(c) for c in columns))
    codes = [f"{n}.{c}" for n in names for c in columns]
    cells = [F.coalesce(F.col(f"`{n}_{c}`").cast("string"), F.lit("")) for n in names for c in columns]
    day = F.date_format("dt", "yyyyMMdd")
    lines = wide.select(day.cast("long").alias("at"), F.concat_ws(",", day, *cells).alias("value"))
    heads = measures.sparkSession.createDataFrame([(0, "," + ",".join(codes)), (1, "Source" + "," * len(codes)), (2, "DateID," + ",".join(codes))], "at long, value string")
    heads.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)


def wide_measures(spark: SparkSession, path: str) -> DataFrame:
    """dt and one text column for each code of the third header line; lines without a date are left
    out."""
    lines = spark.read.text(path)
    codes = lines.where(F.col("value").startswith("DateID,")).first()["value"].split(",")[1:]
    parts = F.split("value", ",", -1)
    rows = lines.where(F.col("value").rlike(r"^\d{8},"))
    return rows.select(F.to_date(parts[0], "yyyyMMdd").alias("dt"), *(parts[i + 1].alias(c) for i, c in enumerate(codes)))


def series_measures(wide: DataFrame) -> DataFrame:
    """series, dt, rv, r, closeprice out of the wide table; what is no number is null."""
    codes = [c for c in wide.columns if c != "dt"]
    long = wide.unpivot("dt", [F.col(f"`{c}`") for c in codes], "code", "value")
    at = F.split("code", r"\.")
    long = long.select("dt", at[0].alias("series"), at[1].alias("measure"), F.col("value").try_cast("double").alias("value"))
    return long.groupBy("series", "dt").pivot("measure", ["rv", "r", "closeprice"]).agg(F.first("value", ignorenulls=True))


class FeatureStore:
    """Network features by metric and number of neighbours, a partition for each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, features: DataFrame, metric: str, k: int) -> None:
        rows = features.withColumn("metric", F.lit(metric)).withColumn("k", F.lit(k))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "k").parquet(self.path)

    def has(self, metric: str, k: int) -> bool:
        return exists(self.spark, f"{self.path}/metric={metric}/k={k}")

    def load(self, metric: str, k: int) -> DataFrame:
        return self.spark.read.parquet(self.path).where((F.col("metric") == metric) & (F.col("k") == k)).drop("metric", "k")


def write_results(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def results(spark: SparkSession, path: str, kinds: str = REGRESSION) -> DataFrame:
    return spark.read.schema(kinds).json(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.repartition("series", F.year("dt")).write.mode("overwrite").partitionBy("series").parquet(path)


PARAMETERS = "series STRING, fold INT, category STRING, model STRING, parts ARRAY<STRUCT<part: STRING, params: ARRAY<STRUCT<kind: STRING, name: STRING, value: DOUBLE>>>>"


def write_parameters(params: DataFrame, path: str) -> None:
    """A document for each series, fold and model, of its parts and what each has learned."""
    keys = ["series", "fold", "category", "model"]
    parts = params.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("kind", "name", "value"))).alias("params"))
    parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "params"))).alias("parts")).write.mode("overwrite").json(path)


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """series, fold, category, model, part, kind, name, value out of exported parameters."""
    keys = ["series", "fold", "category", "model"]
    out = spark.read.schema(PARAMETERS).json(path).select(*keys, F.explode("parts").alias("p"))
    return out.select(*keys, "p.part", F.explode("p.params").alias("x")).select(*keys, "part", "x.*")


def write_table(table: DataFrame, path: str) -> None:
    """A small table as CSV, in the place of an older one."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def graph_documents(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, params: dict[str, str]) -> DataFrame:
    """A document for each snapshot: nodes, edges src < dst with weights of six digits, counts, mean
    absolute correlation and the parameters. An array holds one snapshot's graph, which the universe
    and the number of neighbours bound."""
    named = nodes.groupBy("snapshot").agg(F.sort_array(F.collect_set("src")).alias("nodes"))
    weight = F.round("d", 6).alias("weight")
    links = edges.where("src < dst").groupBy("snapshot").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), weight))).alias("edges"))
    level = pairs.groupBy("snapshot").agg(F.avg(F.abs("rho")).alias("avg_abs_corr"))
    none = F.array().cast("array<struct<source:string,target:string,weight:double>>")
    out = named.join(links, "snapshot", "left").join(level, "snapshot", "left").withColumn("edges", F.coalesce("edges", none))
    hyper = F.create_map(*(F.lit(x) for kv in params.items() for x in kv))
    return out.select("snapshot", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), "avg_abs_corr", "nodes", "edges", hyper.alias("hyperparams"))


GRAPH = "snapshot INT, n_nodes INT, n_edges INT, avg_abs_corr DOUBLE, nodes ARRAY<STRING>, edges ARRAY<STRUCT<source: STRING, target: STRING, weight: DOUBLE>>, hyperparams MAP<STRING, STRING>"


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """snapshot, source, target, weight out of exported graphs."""
    return spark.read.schema(GRAPH).json(path).select("snapshot", F.explode("edges").alias("e")).select("snapshot", "e.*")


def write_features(features: DataFrame, path: str, prefix: str = "net_", series: list[str] | None = None) -> None:
    """series, ISO date and the columns with the prefix as JSON; infinite values become null."""
    rows = features if series is None else features.where(F.col("series").isin(series))
    finite = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c)).alias(c) for c in features.columns if c.startswith(prefix)]
    rows.select("series", F.date_format("dt", "yyyy-MM-dd").alias("date"), *finite).write.mode("overwrite").json(path)
