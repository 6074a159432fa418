"""Metrics, summaries, rankings and tests over tables of fold results."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(preds: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """R2, RMSE, MAE of y_true and y_pred, raw and in logs (clipped at eps)."""
    ly, lp = F.log(F.greatest("y_true", F.lit(eps))), F.log(F.greatest("y_pred", F.lit(eps)))
    out = []
    for y, p, end in ((F.col("y_true"), F.col("y_pred"), ""), (ly, lp, "_log")):
        out += [
            (1 - F.try_divide(F.sum((y - p) ** 2), F.var_pop(y) * F.count(y))).alias(f"R2{end}"),
            F.sqrt(F.avg((y - p) ** 2)).alias(f"RMSE{end}"),
            F.avg(F.abs(y - p)).alias(f"MAE{end}"),
        ]
    return preds.groupBy(*keys).agg(*out)


def classification_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """F1, precision, recall (0 on no cases), accuracy and tie-aware ROC-AUC of label, pred, proba."""
    ties = Window.partitionBy(*keys, "proba")
    order = Window.partitionBy(*keys).orderBy("proba")
    ranked = preds.withColumn("r", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    y, p = F.col("label") == 1, F.col("pred") == 1
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n1, n0 = F.count_if(y), F.count_if(~y)
    auc = F.when((n1 > 0) & (n0 > 0), (F.sum(F.when(y, F.col("r"))) - n1 * (n1 + 1) / 2) / (n1 * n0))
    return ranked.groupBy(*keys).agg(
        zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("F1"),
        zero(F.try_divide(tp, tp + fp)).alias("Precision"),
        zero(F.try_divide(tp, tp + fn)).alias("Recall"),
        F.avg((F.col("label") == F.col("pred")).cast("int")).alias("Accuracy"),
        auc.alias("ROC_AUC"),
    )


def clip_extremes(df: DataFrame, floor: float = -1e6) -> DataFrame:
    return df.where((F.col("R2") > floor) & (F.col("R2_log") > floor))


def summarize(df: DataFrame, model_floor: float = -100.0) -> DataFrame:
    """Means over folds per ticker, then mean, median, share positive and number of tickers."""
    by = df.groupBy("Category", "Ticker", "Model").agg(*(F.avg(c).alias(c) for c in ("RMSE_log", "R2_log", "RMSE", "R2")))
    good = by.groupBy("Category", "Model").agg(F.avg("R2").alias("m")).where(F.col("m") >= model_floor).drop("m")
    return by.join(good, ["Category", "Model"], "left_semi").groupBy("Category", "Model").agg(
        F.avg("RMSE_log").alias("mean_RMSE_log"),
        F.median("RMSE_log").alias("median_RMSE_log"),
        F.avg("R2_log").alias("mean_R2_log"),
        F.avg((F.col("R2_log") > 0).cast("double")).alias("share_positive"),
        F.count_distinct("Ticker").alias("n_tickers"),
    )


def best(df: DataFrame, group: list[str], metric: str, higher: bool = False) -> DataFrame:
    """The best row of each group; ties by Category, then Model."""
    value = F.round(metric, 9)
    order = [value.desc_nulls_last() if higher else value.asc_nulls_last(), F.col("Category"), F.col("Model")]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def decode(category: Column) -> dict[str, Column]:
    """k, base name, distance, weighting and structure that a category's name holds."""
    base = F.trim(F.regexp_replace(category, r"\s*\[k=\d+\]", ""))
    k = F.regexp_extract(category, r"\[k=(\d+)\]", 1)
    return {
        "k": k.try_cast("int"),
        "base": base,
        "is_network": category.contains("[k="),
        "distance": F.when(base.startswith("PCorr"), "PCorr").when(base.startswith("MI"), "MI").otherwise("SqCorr"),
        "weighting": F.when(base.contains("Learned"), "Learned").when(base.startswith("Exp"), "Exp").otherwise("IDW"),
        "structure": F.when(base.contains("Split") & base.contains("Cluster"), "Split+Cluster").when(base.contains("Split"), "Split").when(base.contains("Cluster"), "Clustering").otherwise("Plain"),
    }


def coalesce_categories(df: DataFrame, metric: str = "R2", higher: bool = True) -> DataFrame:
    """Keep, per base category, the rows of the k whose best model wins."""
    parts = decode(F.col("Category"))
    rows = df.withColumn("Base", parts["base"])
    means = rows.groupBy("Base", "Category", "Model").agg(F.avg(metric).alias("m"))
    win = best(means, ["Base"], "m", higher).select("Category")
    return rows.join(win, "Category", "left_semi")


def k_breakdown(df: DataFrame, metric: str = "RMSE_log") -> DataFrame:
    """The best model's mean metric per base category, one column for each k."""
    parts = decode(F.col("Category"))
    rows = df.withColumn("Base", parts["base"]).withColumn("k", F.coalesce(parts["k"], F.lit(0)))
    means = rows.groupBy("Base", "k", "Category", "Model").agg(F.avg(metric).alias("m"))
    return best(means, ["Base", "k"], "m").groupBy("Base").pivot("k", list(range(6))).agg(F.first("m")).select("Base", *(F.col(str(i)).alias(f"k{i}") for i in range(6)))


def ablation(df: DataFrame, axes: list[str], metric: str = "RMSE_log", higher: bool = False, only: dict[str, str] | None = None) -> DataFrame:
    """The best network model for every combination of the named axes; `only` keeps the categories
    that have the given values on other axes."""
    parts = decode(F.col("Category"))
    rows = df.withColumns({a: parts[a] for a in axes}).where(parts["is_network"])
    for axis, value in (only or {}).items():
        rows = rows.where(parts[axis] == value)
    means = rows.groupBy(*axes, "Category", "Model").agg(F.avg(metric).alias("value"))
    return best(means, axes, "value", higher).select(*axes, "Category", "Model", "value")


#: The tables of an ablation study, by name: their axes.
ABLATIONS = {"k_distance": ["distance", "k"], "structure_distance": ["structure", "distance"], "distance_structure": ["distance", "structure"], "weighting": ["weighting"]}


def full_ablation(df: DataFrame, metric: str = "RMSE_log", higher: bool = False) -> DataFrame:
    """All tables of `ABLATIONS` in one: table, the four axes (null where a table has not that axis),
    Category, Model, value. The means per category and model are made once."""
    parts = decode(F.col("Category"))
    axes = ["k", "distance", "structure", "weighting"]
    means = df.where(parts["is_network"]).groupBy("Category", "Model").agg(F.avg(metric).alias("value")).withColumns({a: parts[a] for a in axes})
    out = None
    for name, own in ABLATIONS.items():
        kinds = {"k": "int"}
        shown = [F.col(a) if a in own else F.lit(None).cast(kinds.get(a, "string")).alias(a) for a in axes]
        table = best(means, own, "value", higher).select(F.lit(name).alias("table"), *shown, "Category", "Model", "value")
        out = table if out is None else out.unionByName(table)
    return out


def structural_table(df: DataFrame, axis: str, metric: str = "RMSE_log", r2: str = "R2_log", higher: bool = False) -> DataFrame:
    """For each value of an axis the best network model, its metric, mean and median over tickers, and
    the share of tickers with a positive `r2`."""
    parts = decode(F.col("Category"))
    by = df.where(parts["is_network"]).groupBy("Category", "Ticker", "Model").agg(F.avg(metric).alias("m"), F.avg(r2).alias("r2"))
    means = by.groupBy("Category", "Model").agg(F.avg("m").alias("mean"), F.median("m").alias("median"), F.avg((F.col("r2") > 0).cast("double")).alias("share_positive")).withColumn(axis, parts[axis])
    return best(means, [axis], "mean", higher).select(axis, "Category", "Model", "mean", "median", "share_positive")


def weighting_breakdown(df: DataFrame, metric: str = "RMSE_log", higher: bool = False) -> DataFrame:
    """For each graph (the distance of its edges) and weighting the best model by its mean over all
    the categories of the group."""
    parts = decode(F.col("Category"))
    rows = df.where(parts["is_network"]).select(parts["distance"].alias("graph"), parts["weighting"].alias("weighting"), "Model", metric)
    means = rows.groupBy("graph", "weighting", "Model").agg(F.avg(metric).alias("value")).withColumn("Category", F.col("graph"))
    return best(means, ["graph", "weighting"], "value", higher).select("graph", "weighting", "Model", "value")


def best_per_value(df: DataFrame, axes: list[str], metric: str = "RMSE_log", higher: bool = False) -> DataFrame:
    """axis, label, value: the best mean metric of a network model for each value of each axis."""
    parts = decode(F.col("Category"))
    means = df.where(parts["is_network"]).groupBy("Category", "Model").agg(F.avg(metric).alias("value"))
    labels = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), parts[a].cast("string").alias("label")) for a in axes)))
    extreme = F.max if higher else F.min
    return means.select("value", labels.alias("x")).select("x.axis", "x.label", "value").groupBy("axis", "label").agg(extreme("value").alias("value"))


def scaled(df: DataFrame, factor: float, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in columns})


def summarize_spikes(df: DataFrame) -> DataFrame:
    """Means over folds per ticker, then mean and median of every score, and the number of tickers."""
    scores = ["ROC_AUC", "F1", "Precision", "Recall", "Weighted_Recall", "Accuracy"]
    by = df.groupBy("Category", "Ticker", "Model").agg(*(F.avg(c).alias(c) for c in scores))
    return by.groupBy("Category", "Model").agg(*(F.avg(c).alias(f"mean_{c}") for c in scores), F.median("ROC_AUC").alias("median_ROC_AUC"), F.count_distinct("Ticker").alias("n_tickers"))


def leaderboard(summary: DataFrame, metric: str, higher: bool = False) -> DataFrame:
    """The best model of each category with its place among them; place 1 is the overall best."""
    value = F.round(metric, 9)
    order = [value.desc_nulls_last() if higher else value.asc_nulls_last(), F.col("Category")]
    rows = best(summary, ["Category"], metric, higher)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of categories, some dozens


def paired_differences(df: DataFrame, metric: str = "RMSE_log") -> DataFrame:
    """Per ticker the metric of the best network and the best baseline model, and their difference."""
    net = decode(F.col("Category"))["is_network"]
    by = df.groupBy("Category", "Ticker", "Model").agg(F.avg(metric).alias("m"))
    means = by.groupBy("Category", "Model").agg(F.avg("m").alias("mm")).withColumn("net", net)
    win = best(means, ["net"], "mm")
    own = by.join(win.select("Category", "Model", "net"), ["Category", "Model"])
    a, b = own.where("net").select("Ticker", F.col("m").alias("network")), own.where("not net").select("Ticker", F.col("m").alias("baseline"))
    return a.join(b, "Ticker").withColumn("delta", F.col("network") - F.col("baseline"))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank sums of `delta`, zeros dropped, average ranks for ties, z, the numbers of
    tickers that each side wins, and mean and median of `delta`.

    A rank is a count: how many values are smaller, so it comes from the counts per distinct value and
    a running sum over them."""
    rows = pairs.withColumn("ad", F.round(F.abs("delta"), 12)).withColumn("used", F.col("ad") > 0)
    ties = rows.where("used").groupBy("ad").agg(F.count(F.lit(1)).alias("ties"))
    ranks = ties.select("ad", "ties", (F.sum("ties").over(Window.orderBy("ad")) - (F.col("ties") - 1) / 2).alias("r"))  # of tickers
    rows = rows.join(ranks, "ad", "left")
    up, down = F.coalesce(F.sum(F.when(F.col("used") & (F.col("delta") > 0), F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("used") & (F.col("delta") < 0), F.col("r"))), F.lit(0.0))
    out = rows.agg(
        F.count_if("used").alias("n"), up.alias("w_plus"), down.alias("w_minus"), F.count_if(F.col("used") & (F.col("delta") < 0)).alias("network_wins"), F.count_if(F.col("used") & (F.col("delta") > 0)).alias("baseline_wins"),
        F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), F.coalesce(F.max("ties"), F.lit(0)).alias("most_ties"), F.coalesce(F.sum(F.col("ties") * F.col("ties") - 1), F.lit(0)).alias("tied"),
    )
    w, m = F.least("w_plus", "w_minus"), F.col("n") * (F.col("n") + 1)
    spread = F.sqrt(m * (2 * F.col("n") + 1) / 24 - F.col("tied") / 48)
    return out.withColumn("z", F.try_divide(w - m / 4, spread)).drop("tied")


def with_p_values(tests: DataFrame, most: int = 50) -> DataFrame:
    """Adds p_two_sided and p_one_sided (that `delta` is below 0): exact for `most` pairs or fewer
    without ties, else from the normal distribution of z without continuity correction."""

    def run(batches):
        for b in batches:
            both, one = zip(*(_p_values(int(n), p, m, int(t), z, most) for n, p, m, t, z in zip(b["n"], b["w_plus"], b["w_minus"], b["most_ties"], b["z"], strict=True)), strict=True) if len(b) else ((), ())
            yield b.assign(p_two_sided=list(both), p_one_sided=list(one))

    kinds = ", ".join(f"{n} {t}" for n, t in tests.dtypes)
    return tests.mapInPandas(run, f"{kinds}, p_two_sided double, p_one_sided double")


def _p_values(n: int, w_plus: float, w_minus: float, most_ties: int, z: float | None, most: int) -> tuple[float, float]:
    if n == 0:
        return 1.0, 1.0
    if n <= most and most_ties <= 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):  # sign sums of ranks 1..n
            ways[r:] = ways[r:] + ways[:-r]
        below = lambda w: float(ways[: int(round(w)) + 1].sum() / ways.sum())
        return min(1.0, 2 * below(min(w_plus, w_minus))), below(w_plus)
    half = math.erfc(abs(z or 0.0) / math.sqrt(2)) / 2
    return 2 * half, half if w_plus <= w_minus else 1 - half


def weighted_recall(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Recall weighted by ln(1 + y_true) over the positives; null without positives."""
    y, w = F.col("label") == 1, F.log1p("y_true")
    got = F.try_divide(F.sum(F.when(y & (F.col("pred") == 1), w).otherwise(F.when(y, 0.0))), F.sum(F.when(y, w)))
    return preds.groupBy(*keys).agg(got.alias("Weighted_Recall"))


def per_ticker(df: DataFrame, metric: str = "RMSE_log") -> DataFrame:
    """The tickers' means of the best model of each category."""
    by = df.groupBy("Category", "Ticker", "Model").agg(F.avg(metric).alias("value"))
    win = best(by.groupBy("Category", "Model").agg(F.avg("value").alias("m")), ["Category"], "m")
    return by.join(win.select("Category", "Model"), ["Category", "Model"], "left_semi")


def without_outlying_tickers(df: DataFrame, floor: float = -1.0) -> DataFrame:
    """The rows of tickers whose mean R2 is not below `floor`."""
    bad = df.groupBy("Ticker").agg(F.avg("R2").alias("m")).where(F.col("m") < floor)
    return df.join(bad.select("Ticker"), "Ticker", "left_anti")


def extremes(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The `n` tickers with the smallest and the `n` with the largest delta, with their places."""
    out = None
    for side, order in (("network", F.round("delta", 9).asc()), ("baseline", F.round("delta", 9).desc())):
        top = pairs.orderBy(order, "Ticker").limit(n)
        top = top.withColumn("place", F.row_number().over(Window.orderBy(order, "Ticker"))).withColumn("favours", F.lit(side))
        out = top if out is None else out.unionByName(top)
    return out


def select_on_validation(df: DataFrame, fold: int, metric: str = "RMSE_log") -> DataFrame:
    """Per category the model with the best median of the validation fold."""
    by = df.where(F.col("Fold") == fold).groupBy("Category", "Model").agg(F.median(metric).alias("value"))
    return best(by, ["Category"], "value")


def report_on_test(df: DataFrame, validation: int, test: int, metric: str = "RMSE_log") -> DataFrame:
    """The models chosen on the validation fold, summarised on the test fold."""
    chosen = select_on_validation(df, validation, metric).select("Category", "Model")
    return summarize(df.where(F.col("Fold") == test).join(chosen, ["Category", "Model"], "left_semi"))


def baseline_and_network(df: DataFrame, metric: str = "RMSE_log") -> DataFrame:
    """The best baseline and the best network model, a row each."""
    means = df.groupBy("Category", "Model").agg(F.avg(metric).alias("value")).withColumn("is_network", decode(F.col("Category"))["is_network"])
    return best(means, ["is_network"], "value")


def paired_spikes(df: DataFrame, metric: str = "ROC_AUC") -> DataFrame:
    """`paired_differences` of a score of which more is better: the sign is turned, so that a delta
    below 0 still favours the network."""
    return paired_differences(df.withColumn(metric, -F.col(metric)), metric).select("Ticker", (-F.col("network")).alias("network"), (-F.col("baseline")).alias("baseline"), "delta")


def best_predictions(preds: DataFrame, metrics: DataFrame, group: Column, metric: str = "RMSE_log", year: int | None = None, factor: float = 1.0) -> DataFrame:
    """The prediction curves of the best model of each series and plotting group (an expression over
    category), of one year if given, times a factor. `metrics` has series, category, model and the
    metric of each fold."""
    means = metrics.groupBy("series", "category", "model").agg(F.avg(metric).alias("m")).withColumn("plot", group)
    win = best(means.withColumnsRenamed({"category": "Category", "model": "Model"}), ["series", "plot"], "m").select("series", "plot", F.col("Category").alias("category"), F.col("Model").alias("model"))
    rows = preds.join(win, ["series", "category", "model"])
    rows = rows if year is None else rows.where(F.year("dt") == year)
    return rows.select("series", "plot", "category", "model", "fold", "dt", (F.col("y_true") * factor).alias("y_true"), (F.col("y_pred") * factor).alias("y_pred"))


def whole_spike_report(metrics: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report on saved scores of spikes: the best k of each category by ROC-AUC, then
    summary, leaderboard, tickers, k and weighting breakdowns, structure, deltas and test."""
    score = "ROC_AUC"
    chosen = coalesce_categories(metrics, score, True)
    summary = summarize_spikes(chosen)
    pairs = paired_spikes(chosen)
    return {
        "summary": summary,
        "leaderboard": leaderboard(summary, f"mean_{score}", True),
        "k_breakdown": ablation(metrics, ["k"], score, True),
        "weighting": weighting_breakdown(metrics, score, True),
        "structure": ablation(chosen, ["structure"], score, True),
        "extremes": extremes(pairs),
        "test": with_p_values(signed_rank(pairs)),
    }


def whole_report(metrics: DataFrame, selection: str = "R2", higher: bool = True, factor: float = 1.0) -> dict[str, DataFrame]:
    """The tables of a report on saved results: floors, display scale, the best k of each category,
    then summary, leaderboard, k breakdown (of all k), weighting breakdown, structure, deltas and test."""
    rows = scaled(clip_extremes(metrics), factor, ["RMSE", "MAE"])
    chosen = coalesce_categories(rows, selection, higher)
    summary = summarize(chosen)
    pairs = paired_differences(chosen)
    return {
        "summary": summary,
        "leaderboard": leaderboard(summary, "mean_RMSE_log"),
        "per_ticker": per_ticker(chosen),
        "without_outliers": summarize(without_outlying_tickers(chosen)),
        "k_breakdown": k_breakdown(rows),
        "weighting": weighting_breakdown(rows),
        "structure": structural_table(chosen, "structure"),
        "extremes": extremes(pairs),
        "test": with_p_values(signed_rank(pairs)),
    }
