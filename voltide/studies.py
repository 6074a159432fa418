"""Queries over files, models and reports, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide import catalog as c
from voltide import further
from voltide.catalog import K, METRICS, NET, PAIRS, PANEL, STEP, TEST, TRAIN, WINDOW, r, rounded
from voltide.functions import features as fx
from voltide.operators import eda, forecasting, models, network, reports, timeseries
from voltide.sources import files, panels
from voltide.sources.store import new_folder, written

GARCH = (0.05, 0.08, 0.9)  # omega as a share of the mean square, alpha, beta
SERIES = [f"Brand#{i}" for i in range(1, 26)]


# ---------------------------------------------------------------- files


def a_universe(spark, d):
    by = panels.sales(spark, d).groupBy("series").agg(F.sum("price").alias("v"))
    ranked = by.select(F.row_number().over(c.Window.orderBy(F.desc("v"), "series")).alias("rank"), F.concat(F.lit("Company "), "series").alias("company"), F.col("series").alias("symbol"))
    path = new_folder(spark)
    files.write_universe(ranked, path)
    return rounded(files.universe(spark, path, 10))


def _bar_files(spark, d):
    path = new_folder(spark)
    market = panels.sales(spark, d).withColumn("series", F.lit("MARKET"))
    unit = F.col("price") / F.col("qty")
    proxy = market.groupBy("series", F.col("dt").alias("Date")).agg((F.sum("price") / F.sum("qty")).alias("Adj Close"), F.max_by(unit, "place").alias("Close"), F.max(unit).alias("High"), F.min(unit).alias("Low"), F.min_by(unit, "place").alias("Open"), F.sum("qty").cast("long").alias("Volume"))
    files.write_bars(panels.ohlcv(spark, d).unionByName(proxy), path)
    return files.bars(spark, path)


def a_bars(spark, d):
    return rounded(_bar_files(spark, d).where("series <> 'MARKET'"))


def _market_of(found):
    own = fx.returns(files.price_panel(found.where("series = 'MARKET'")))
    return own.select("dt", F.col("Returns").alias("Market_Returns")).where("Market_Returns is not null")


def a_market_series(spark, d):
    return rounded(_market_of(_bar_files(spark, d)))


def a_stock_panel(spark, d):
    found = _bar_files(spark, d)
    out = fx.har_panel(files.price_panel(found.where("series <> 'MARKET'")), _market_of(found))
    return rounded(out.select("series", "dt", *fx.HAR_COLUMNS, "Market_Returns", "log_Market_RV5", "log_Market_RV22"), 5)


def _wide_file(spark, d):
    path = new_folder(spark)
    rows = panels.realised(spark, d, "day")
    names = sorted(x["series"] for x in rows.select("series").distinct().collect())
    files.write_wide(rows, path, names)
    return files.wide_measures(spark, path)


def a_wide_table(spark, d):
    wide = _wide_file(spark, d)
    codes = [x for x in wide.columns if x != "dt"]
    return rounded(wide.unpivot("dt", [F.col(f"`{x}`") for x in codes], "code", "value").select("dt", "code", F.nullif("value", F.lit("")).cast("double").alias("value")), 5)


def a_series_measures(spark, d):
    return rounded(files.series_measures(_wide_file(spark, d)).where("rv is not null or r is not null"), 5)


def a_index_panel(spark, d):
    rows = fx.fill_and_keep(files.series_measures(_wide_file(spark, d)), ["rv", "r", "closeprice"], 20)
    return rounded(fx.realised_features(rows).drop("rv", "r", "closeprice"), 5)


def a_feature_store(spark, d):
    store = files.FeatureStore(spark, new_folder(spark))
    p = written(c.pairs(spark, d))
    for k in (1, 3):
        store.save(network.degrees(network.nodes(p), network.knn_edges(p, k)), "sqcorr", k)
    if not store.has("sqcorr", 3) or store.has("sqcorr", 2):
        raise RuntimeError("the store lost a partition")
    return rounded(store.load("sqcorr", 3))


def a_results(spark, d):
    path = new_folder(spark)
    files.write_results(panels.metrics(spark, d), path)
    return rounded(files.results(spark, path).select("Category", "Ticker", "Model", "Fold", "RMSE_log", "R2_log", "RMSE", "R2", "MAE"))


def _naive(spark, d, fold=0, sold=None):
    rows = fx.folds(c.featured(spark, d, sold=sold).dropna(subset=["RV22", "Y_fwd"]), 2, TEST, TRAIN).where((F.col("role") == "test") & (F.col("fold") == fold))
    return rows.select("series", "dt", F.col("Y_fwd").alias("y_true"), models.naive_week().alias("week"), models.naive_month().alias("month"))


def a_predictions(spark, d):
    path = new_folder(spark)
    files.write_predictions(_naive(spark, d), path)
    return rounded(spark.read.parquet(path).select("series", "dt", "y_true", "week", "month"), 5)


def _graph_export(spark, d):
    p, e = c.graph(spark, d)
    path = new_folder(spark)
    files.graph_documents(network.nodes(p), e, p, {"window": str(WINDOW), "step": str(STEP), "k": str(K)}).write.json(path)
    return path


def a_graph_export(spark, d):
    return rounded(spark.read.schema(files.GRAPH).json(_graph_export(spark, d)).select("snapshot", "n_nodes", "n_edges", "avg_abs_corr", F.array_join("nodes", ",").alias("nodes"), F.col("hyperparams")["k"].alias("k")))


def a_graph_edges(spark, d):
    return rounded(files.graph_edges(spark, _graph_export(spark, d)), 5)


def a_feature_export(spark, d):
    sold = panels.totals(spark, d)
    p, e = c.graph(spark, d, sold=sold)
    rows = network.as_of(c.panel(spark, d, sold=sold), network.turnover(e, network.nodes(p), STEP), ["degree", "turnover"])
    rows = rows.select("series", "dt", F.col("degree").alias("net_degree"), (1 / F.col("turnover").cast("float").cast("double")).alias("other"), F.when(F.col("turnover") == 0, float("inf")).otherwise(F.col("turnover")).alias("net_turnover"))
    path = new_folder(spark)
    files.write_features(rows, path, series=SERIES[:3])
    return rounded(spark.read.schema("series STRING, date STRING, net_degree BIGINT, net_turnover DOUBLE").json(path))


def a_ablation_table(spark, d):
    path = new_folder(spark)
    rows = reports.ablation(panels.metrics(spark, d), ["distance", "k"])
    files.write_table(rows.limit(1), path)  # an older one, which is replaced
    files.write_table(rows, path)
    return rounded(spark.read.option("header", True).schema("distance STRING, k INT, Category STRING, Model STRING, value DOUBLE").csv(path))


# ---------------------------------------------------------------- features


def b_complete_rows(spark, d):
    return rounded(c.featured(spark, d).dropna(subset=["log_RV1", "log_RV5", "log_RV22", "log_Y"]).select("series", "dt", "log_RV22", "log_Y"))


def b_index_market(spark, d):
    rows = panels.realised(spark, d)
    proxy = rows.where(F.col("series") == "view").select("dt", "rv", "r")
    return rounded(fx.realised_market(rows, proxy).select("series", "dt", "Market_Returns", "Market_RV5", "Market_RV22", "log_Market_RV5", "log_Market_RV22"), 5)


def b_har_panel(spark, d):
    sold = panels.totals(spark, d)
    out = fx.har_panel(panels.prices(spark, d, sold=sold), panels.market(spark, d, sold=sold))
    return rounded(out.select("series", "dt", *fx.HAR_COLUMNS, "Market_Returns", "log_Market_RV5", "log_Market_RV22"), 5)


def b_custom_preprocess(spark, d):
    own = lambda df: df.where("Returns_Lag_5 > 0").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("Returns_Lag_5").alias("mean_rise"))
    return rounded(fx.preprocess(panels.prices(spark, d), (5,), own))


def b_spike_labels_lookback(spark, d):
    return rounded(fx.spike_labels(c.featured(spark, d), 0.75, 756).where("Y_fwd is not null").select("series", "dt", "threshold", "spike"))


# ---------------------------------------------------------------- networks


def c_precision_partial_correlation(spark, d):
    return rounded(network.precision_partial(further.held(spark, d)))


def c_custom_distance(spark, d):
    """The extension point: a metric distance of correlations, by a function of the window's matrix."""

    def angle(m):
        rho = network.safe_correlation(m)
        return rho, (2 * (1 - rho)).clip(0) ** 0.5

    return rounded(network.by_matrix(further.held(spark, d), angle), 5)


def c_saved_signs(spark, d):
    p, e = c.graph(spark, d)
    return rounded(network.with_saved_signs(e, p, 5))


def d_global_clustering(spark, d):
    p, e = c.graph(spark, d)
    return rounded(network.global_clustering(network.clustering(e, network.nodes(p))))


def _features(spark, d, kernel="inverse"):
    sold = panels.totals(spark, d)
    p, e = c.graph(spark, d, sold=sold)
    return network.graph_features(p, e, written(c.featured(spark, d, sold=sold)), K, STEP, kernel=kernel)


def d_graph_features(spark, d):
    return rounded(_features(spark, d), 4)


def d_network_panel(spark, d):
    names = ["net_degree", "net_idw_log_RV5"]
    sold = panels.totals(spark, d)
    p, e = c.graph(spark, d, sold=sold)
    values = written(c.featured(spark, d, sold=sold))
    own = network.neighbour_features(e, values, ["log_RV5"]).join(network.degrees(network.nodes(p), e).withColumnRenamed("degree", "net_degree"), ["snapshot", "src"], "right")
    return rounded(network.with_network(values.select("series", "dt", "i"), own, names).select("series", "dt", *names), 5)


def d_features_on_dates(spark, d):
    sold = panels.totals(spark, d)
    p, e = c.graph(spark, d, sold=sold)
    rows = network.as_of(c.panel(spark, d, sold=sold), network.turnover(e, network.nodes(p), STEP), ["degree"])
    orders = panels.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("dt"))
    return rounded(network.on_dates(rows, orders))


def d_degree_table(spark, d):
    p, e = c.graph(spark, d)
    return rounded(network.degree_table(network.degrees(network.nodes(p), e), SERIES))


# ---------------------------------------------------------------- evaluation


def e_task_grid(spark, d):
    grid = forecasting.task_grid(c.panel(spark, d), forecasting.catalogue(spark, forecasting.baselines()), 2, TEST, TRAIN)
    return rounded(grid)


def e_filled_network(spark, d):
    sold = panels.totals(spark, d)
    p, e = c.graph(spark, d, sold=sold)
    rows = network.as_of(c.panel(spark, d, sold=sold), network.turnover(e, network.nodes(p), STEP), ["degree", "turnover"]).withColumnsRenamed({"degree": "net_degree", "turnover": "net_degree_change"})
    return rounded(forecasting.fill_net(rows))


def e_merged_predictions(spark, d):
    sold = panels.totals(spark, d)
    week = _naive(spark, d, 0, sold).unionByName(_naive(spark, d, 1, sold)).select("series", "dt", "y_true", "week")
    month = _naive(spark, d, 1, sold).where("dt >= '2000-01-01'").select("series", "dt", "y_true", "month")
    return rounded(forecasting.merge_predictions(month, week).select("series", "dt", "y_true", "week", "month"), 5)


def e_all_metrics(spark, d):
    m = panels.metrics(spark, d).select("Category", "Ticker", "Model", "Fold", "RMSE_log")
    return rounded(m.where("Category = 'HAR'").unionByName(m.where("Category <> 'HAR'")))


def m_arima(spark, d):
    return rounded(reports.regression_metrics(timeseries.arima_forecasts(c.featured(spark, d), n_splits=1, test=TEST, min_train=TRAIN), ["category", "model", "series", "fold"]))


def m_garch(spark, d):
    return rounded(reports.regression_metrics(timeseries.garch_forecasts(c.featured(spark, d), n_splits=1, test=TEST, min_train=TRAIN), ["category", "model", "series", "fold"]))


def m_dynamic_correlation(spark, d):
    return rounded(reports.regression_metrics(timeseries.dcc_forecasts(c.with_market(spark, d), n_splits=1, test=TEST, min_train=TRAIN), ["category", "model", "series", "fold"]))


def m_dynamic_correlation_spikes(spark, d):
    return rounded(reports.classification_metrics(timeseries.dcc_spikes(c.with_market(spark, d), n_splits=1, test=TEST, min_train=TRAIN), ["category", "model", "series", "fold"]))


def _one_column(spark, d):
    rows = fx.folds(c.featured(spark, d).dropna(subset=["log_RV1", "log_RV5", "log_RV22", "log_Y"]), 1, TEST, TRAIN).where("role = 'train'")
    return models.gram(rows, ["series"], ["log_RV5"], "log_Y"), rows


def m_penalised(spark, d):
    g, _ = _one_column(spark, d)
    out = None
    for name, args in (("ridge", {"ridge": 50.0}), ("lasso", {"lasso": 0.05})):
        own = models.fit_linear(g, ["series"], **args).select("series", F.lit(name).alias("penalty"), F.element_at("coef", 1).alias("slope"), "intercept")
        out = own if out is None else out.unionByName(own)
    return rounded(out, 5)


def m_har_three(spark, d):
    _, rows = _one_column(spark, d)
    got = models.fit_linear(models.gram(rows, ["series"], ["log_RV1", "log_RV5", "log_RV22"], "log_Y"), ["series"])
    return rounded(got.select("series", *(F.element_at("coef", i + 1).alias(f"b{i + 1}") for i in range(3)), "intercept"), 4)


def m_variance_filter(spark, d):
    """Conditional variances of the daily returns for given parameters."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        x = pdf["Returns"].to_numpy()
        start = float((x**2).mean())
        h = timeseries.variance_filter(x, np.array([GARCH[0] * start]), np.array([[GARCH[1]]]), np.array([[GARCH[2]]]), start)
        return pd.DataFrame({"series": pdf["series"], "dt": pdf["dt"], "variance": h[:-1, 0]})

    rows = c.panel(spark, d).where("Returns is not null").select("series", "dt", "Returns")
    return rounded(rows.groupBy("series").applyInPandas(run, "series string, dt date, variance double"), 4)


# ---------------------------------------------------------------- reports


def g_display_scale(spark, d):
    return rounded(reports.scaled(panels.metrics(spark, d), 1e4, ["RMSE", "MAE"]).select("Category", "Ticker", "Model", "Fold", "RMSE", "MAE"), 3)


def g_spike_summary(spark, d):
    return rounded(reports.summarize_spikes(panels.spike_metrics(spark, d)))


def g_leaderboard(spark, d):
    return rounded(reports.leaderboard(reports.summarize(panels.metrics(spark, d)), "mean_RMSE_log").select("place", "Category", "Model", "mean_RMSE_log"))


def g_spike_leaderboard(spark, d):
    return rounded(reports.leaderboard(reports.summarize_spikes(panels.spike_metrics(spark, d)), "mean_ROC_AUC", True).select("place", "Category", "Model", "mean_ROC_AUC"))


def g_signed_rank_p(spark, d):
    out = reports.with_p_values(reports.signed_rank(reports.paired_differences(panels.metrics(spark, d))))
    return rounded(out.select("n", "w_plus", "w_minus", "network_wins", "baseline_wins", "mean_delta", "median_delta", "p_two_sided", "p_one_sided"))


def g_spike_signed_rank(spark, d):
    out = reports.signed_rank(reports.paired_spikes(panels.spike_metrics(spark, d)))
    return rounded(out.select("n", "w_plus", "w_minus", "network_wins", "baseline_wins", "mean_delta", "median_delta"))


def g_weighting_breakdown(spark, d):
    return rounded(reports.weighting_breakdown(panels.spike_metrics(spark, d), "ROC_AUC", True))


def g_structural_table(spark, d):
    return rounded(reports.structural_table(panels.metrics(spark, d), "distance"))


def g_full_ablation(spark, d):
    return rounded(reports.full_ablation(panels.metrics(spark, d)))


def g_filtered_ablation(spark, d):
    return rounded(reports.ablation(panels.spike_metrics(spark, d), ["structure"], "ROC_AUC", True, {"weighting": "IDW"}))


def g_best_per_value(spark, d):
    return rounded(reports.best_per_value(panels.metrics(spark, d), ["k", "distance"]))


def g_prediction_curves(spark, d):
    rows = _naive(spark, d)
    stack = F.explode(F.map_from_arrays(F.array(F.lit("week"), F.lit("month")), F.array("week", "month"))).alias("model", "y_pred")
    preds = rows.select("series", F.lit("Naive").alias("category"), F.lit(0).alias("fold"), "dt", "y_true", stack)
    scores = reports.regression_metrics(preds, ["series", "category", "model", "fold"])
    return rounded(reports.best_predictions(preds, scores, F.lit("naive"), year=2001, factor=2.0).select("series", "model", "dt", "y_true", "y_pred"), 4)


def g_whole_report(spark, d):
    path = new_folder(spark)
    files.write_results(panels.metrics(spark, d), path)
    return rounded(reports.whole_report(files.results(spark, path))["leaderboard"].select("place", "Category", "Model", "mean_RMSE_log", "n_tickers"))


# ---------------------------------------------------------------- exploration


def h_date_slice(spark, d):
    return rounded(eda.between(c.panel(spark, d), "1998-03-01", "1999-02-28").select("series", "dt", "Returns"))


def h_common_autocorrelation(spark, d):
    return rounded(eda.common_autocorrelation(c.panel(spark, d), lags=20))


def h_sigma_outliers(spark, d):
    return rounded(eda.sigma_outliers(c.panel(spark, d), z=2.0))


QUERIES = {f.__name__: f for f in (
    a_universe, a_bars, a_market_series, a_stock_panel, a_wide_table, a_series_measures, a_index_panel, a_feature_store, a_results, a_predictions, a_graph_export, a_graph_edges, a_feature_export, a_ablation_table,
    b_complete_rows, b_index_market, b_har_panel, b_custom_preprocess, b_spike_labels_lookback, c_precision_partial_correlation, c_custom_distance, c_saved_signs,
    d_global_clustering, d_graph_features, d_network_panel, d_features_on_dates, d_degree_table, e_task_grid, e_filled_network, e_merged_predictions, e_all_metrics,
    m_arima, m_garch, m_dynamic_correlation, m_dynamic_correlation_spikes, m_penalised, m_har_three, m_variance_filter,
    g_display_scale, g_spike_summary, g_leaderboard, g_spike_leaderboard, g_signed_rank_p, g_spike_signed_rank, g_weighting_breakdown, g_structural_table, g_full_ablation, g_filtered_ablation, g_best_per_value,
    g_prediction_curves, g_whole_report, h_date_slice, h_common_autocorrelation, h_sigma_outliers,
)}

_MARKET = """mk0 AS (SELECT dt, sum(price) / sum(qty) AS px FROM items GROUP BY 1), mk AS (SELECT dt, 100 * ln(px / lag(px) OVER (ORDER BY dt)) AS "Market_Returns" FROM mk0),
mj AS (SELECT x.*, "Market_Returns", "Market_Returns" ** 2 AS m2 FROM x LEFT JOIN mk USING (dt)),
mf AS (SELECT *, ln(CASE WHEN count(m2) OVER w5 = 5 THEN avg(m2) OVER w5 END + 1e-8) AS "log_Market_RV5", ln(CASE WHEN count(m2) OVER w22 = 22 THEN avg(m2) OVER w22 END + 1e-8) AS "log_Market_RV22" FROM mj WINDOW w5 AS (PARTITION BY series ORDER BY dt ROWS 4 PRECEDING), w22 AS (PARTITION BY series ORDER BY dt ROWS 21 PRECEDING))"""
_HAR = ", ".join(f'round("{n}", 5) + 0.0 AS "{n}"' for n in [*fx.HAR_COLUMNS, "Market_Returns", "log_Market_RV5", "log_Market_RV22"])
_WHOLE = " AND ".join(f'"{n}" IS NOT NULL' for n in [*fx.HAR_COLUMNS, "Market_Returns", "log_Market_RV5", "log_Market_RV22"])
_GRID = "wk AS (SELECT series, dt, i, last_value(px IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt) AS px FROM grid LEFT JOIN seen USING (series, dt)),"
RAW = PANEL.replace(_GRID, "wk AS (SELECT series, dt, 0 AS i, px FROM seen),")
DAYS = further.REALISED.replace("'hour'", "'day'")
TURN = f"""sm AS (SELECT a.snapshot, a.src, count(*) AS same FROM ed a JOIN ed b ON b.snapshot = a.snapshot - {STEP} AND a.src = b.src AND a.dst = b.dst GROUP BY 1, 2),
tu AS (SELECT d.snapshot, d.src, d.degree, CASE WHEN w.src IS NOT NULL THEN 1 - coalesce(same, 0) / greatest(d.degree, 1) END AS turnover FROM deg d LEFT JOIN deg w ON w.snapshot = d.snapshot - {STEP} AND w.src = d.src LEFT JOIN sm ON sm.snapshot = d.snapshot AND sm.src = d.src)"""
ASOF = TURN + """, ao AS (SELECT series, dt, last_value(degree IGNORE NULLS) OVER w AS degree, last_value(turnover IGNORE NULLS) OVER w AS turnover FROM wk LEFT JOIN tu ON tu.snapshot = wk.i AND tu.src = wk.series WINDOW w AS (PARTITION BY series ORDER BY dt))"""
LOCAL = """tr AS (SELECT a.snapshot, a.src, count(*) AS t FROM ed a JOIN ed b ON a.snapshot = b.snapshot AND a.src = b.src AND a.dst < b.dst JOIN ed c ON c.snapshot = a.snapshot AND c.src = a.dst AND c.dst = b.dst GROUP BY 1, 2),
lc AS (SELECT snapshot, src, CASE WHEN degree < 2 THEN 0.0 ELSE 2 * coalesce(t, 0) / (degree * (degree - 1)) END AS clustering FROM deg LEFT JOIN tr USING (snapshot, src))"""
NAIVE = PANEL + ', xx AS (SELECT * FROM x WHERE "RV22" IS NOT NULL AND "Y_fwd" IS NOT NULL),' + c._folds("xx", 2) + """, nv AS (SELECT series, dt, CAST(fold AS BIGINT) AS fold, "Y_fwd" AS y_true, 5 * "RV5" AS week, 5 * "RV22" AS month FROM fo WHERE role = 'test')"""
ROWS = PANEL + ', xx AS (SELECT * FROM x WHERE "log_RV1" IS NOT NULL AND "log_RV5" IS NOT NULL AND "log_RV22" IS NOT NULL AND "log_Y" IS NOT NULL),' + c._folds("xx", 1) + ", tn AS (SELECT * FROM fo WHERE role = 'train')"
CLF = """WITH m AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'HAR-Logit' WHEN 1 THEN 'ExpKernel Network' || k WHEN 2 THEN 'PCorr Network' || k ELSE 'Network+Clustering' || k END AS "Category", p_brand AS "Ticker", 'C-' || l_returnflag || l_linestatus AS "Model", month(l_shipdate) % 2 AS "Fold",
 CASE WHEN count(*) > 1 THEN avg(CAST(l_discount AS DOUBLE)) * 10 END AS "ROC_AUC", avg(CAST(l_tax AS DOUBLE)) * 12 AS "F1", avg(CAST(l_quantity AS DOUBLE)) / 50 AS "Recall", avg(CAST(l_discount AS DOUBLE) * 8) AS "Precision", avg(CAST(l_tax AS DOUBLE) * 10) AS "Accuracy", stddev_pop(CAST(l_quantity AS DOUBLE)) AS "Weighted_Recall"
 FROM (SELECT *, ' [k=' || (l_suppkey % 5 + 1) || ']' AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2, 3, 4)"""
_SCORES = ["ROC_AUC", "F1", "Precision", "Recall", "Weighted_Recall", "Accuracy"]
CLF_SUMMARY = CLF + ', b AS (SELECT "Category", "Ticker", "Model", ' + ", ".join(f'avg("{n}") AS "{n}"' for n in _SCORES) + ' FROM m GROUP BY 1, 2, 3), s AS (SELECT "Category", "Model", ' + ", ".join(f'avg("{n}") AS "mean_{n}"' for n in _SCORES) + ', median("ROC_AUC") AS "median_ROC_AUC", count(DISTINCT "Ticker") AS n_tickers FROM b GROUP BY 1, 2)'
SIGNED = """, k AS (SELECT delta, rank() OVER (ORDER BY round(abs(delta), 12)) + (count(*) OVER (PARTITION BY round(abs(delta), 12)) - 1) / 2 AS rk FROM pd WHERE round(abs(delta), 12) > 0),
t AS (SELECT count(*) AS n, CAST(coalesce(sum(rk) FILTER (delta > 0), 0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(rk) FILTER (delta < 0), 0) AS DOUBLE) AS w_minus, count(*) FILTER (delta < 0) AS network_wins, count(*) FILTER (delta > 0) AS baseline_wins FROM k),
u AS (SELECT round(avg(delta), 6) + 0.0 AS mean_delta, round(median(delta), 6) + 0.0 AS median_delta FROM pd)"""
_AXES = """CASE WHEN "Base" LIKE 'PCorr%' THEN 'PCorr' WHEN "Base" LIKE 'MI%' THEN 'MI' ELSE 'SqCorr' END AS distance, CASE WHEN "Base" LIKE '%Learned%' THEN 'Learned' WHEN "Base" LIKE 'Exp%' THEN 'Exp' ELSE 'IDW' END AS weighting, CASE WHEN "Base" LIKE '%Split%' AND "Base" LIKE '%Cluster%' THEN 'Split+Cluster' WHEN "Base" LIKE '%Split%' THEN 'Split' WHEN "Base" LIKE '%Cluster%' THEN 'Clustering' ELSE 'Plain' END AS structure"""
_TOP = 'row_number() OVER (PARTITION BY {} ORDER BY round(value, 9), "Category", "Model") = 1'
AXES = METRICS + f', ax AS (SELECT k, "Category", "Model", {_AXES}, avg("RMSE_log") AS value FROM e WHERE k IS NOT NULL GROUP BY ALL)'
_IDW = ", ".join(f'round(sum(w * "{v}") FILTER ("{v}" IS NOT NULL{on}) / sum(w) FILTER ("{v}" IS NOT NULL{on}), 4) + 0.0 AS "net_idw{s}_{v}"' for s, on in (("", ""), ("_pos", " AND rho > 0"), ("_neg", " AND NOT rho > 0")) for v in network.VALUES)
_NN = ", ".join([f'round(max("{v}") FILTER (q = {i}), 4) + 0.0 AS "net_nn{i}_{v}"' for i in range(K) for v in network.VALUES] + [f"round(max(d) FILTER (q = {i}), 4) + 0.0 AS net_nn{i}_dist" for i in range(K)])
_DET = "({a}1 * ({b}2 * {c}3 - {b}3 * {c}2) - {a}2 * ({b}1 * {c}3 - {b}3 * {c}1) + {a}3 * ({b}1 * {c}2 - {b}2 * {c}1))"
_NAMES = ["HAR", "HAR (no outliers)", "HAR-Extended", "HAR-Extended (no outliers)", "HAR-Lasso (a=0.01)", "HAR-Lasso (a=0.1)", "HAR-Ext-Lasso (a=0.01)", "HAR-Ext-Lasso (a=0.1)"]
_REGIMES = ["RegHAR (p50)", "RegHAR (p75)", "RegHAR (p90)", "RegHAR-Lasso (p50)", "RegHAR-Lasso (p75)"]


def _rounded(names, digits):
    return ", ".join(f'round("{n}", {digits}) + 0.0 AS "{n}"' for n in names)


ORACLES = {
    "a_universe": "SELECT row_number() OVER (ORDER BY sum(CAST(l_extendedprice AS DOUBLE)) DESC, p_brand) AS rank, 'Company ' || p_brand AS company, p_brand AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand QUALIFY rank <= 10",
    "a_bars": """WITH u AS (SELECT p_brand AS series, CAST(l_shipdate AS DATE) AS "Date", CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_quantity AS DOUBLE) AS q, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT series, "Date", round(sum(p) / sum(q), 6) + 0.0 AS "Adj Close", round(arg_max(p / q, (l_orderkey, l_linenumber)), 6) + 0.0 AS "Close", round(max(p / q), 6) + 0.0 AS "High", round(min(p / q), 6) + 0.0 AS "Low", round(arg_min(p / q, (l_orderkey, l_linenumber)), 6) + 0.0 AS "Open", CAST(sum(q) AS BIGINT) AS "Volume" FROM u GROUP BY 1, 2""",
    "a_market_series": f'{PANEL}, {_MARKET} SELECT dt, round("Market_Returns", 6) + 0.0 AS "Market_Returns" FROM mk WHERE "Market_Returns" IS NOT NULL',
    "a_stock_panel": f"{RAW}, {_MARKET} SELECT series, dt, {_HAR} FROM mf WHERE {_WHOLE} QUALIFY count(*) OVER (PARTITION BY series) >= 2",
    "a_wide_table": f"{DAYS}, l AS (UNPIVOT (SELECT series, dt, rv, r, closeprice FROM rl) ON rv, r, closeprice INTO NAME m VALUE v), ds AS (SELECT DISTINCT dt FROM rl), cs AS (SELECT DISTINCT series, m FROM (SELECT series FROM rl), (VALUES ('rv'), ('r'), ('closeprice')) t(m)) SELECT CAST(ds.dt AS DATE) AS dt, cs.series || '.' || cs.m AS code, round(v, 5) + 0.0 AS value FROM ds CROSS JOIN cs LEFT JOIN l ON l.dt = ds.dt AND l.series = cs.series AND l.m = cs.m",
    "a_series_measures": f"{DAYS} SELECT series, CAST(dt AS DATE) AS dt, {r('rv', 'r', 'closeprice', digits=5)} FROM rl WHERE rv IS NOT NULL OR r IS NOT NULL",
    "a_index_panel": further.ORACLES["b_realised_features"].replace(further.REALISED, DAYS).replace("SELECT series, dt, last_value(rv", "SELECT series, CAST(dt AS DATE) AS dt, last_value(rv").replace(">= 300", ">= 20"),
    "a_feature_store": PAIRS.replace(f"dst) <= {K})", "dst) <= 3)") + " SELECT snapshot, src, degree FROM deg",
    "a_results": f'{METRICS} SELECT "Category", "Ticker", "Model", "Fold", {r("RMSE_log", "R2_log", "RMSE", "R2", "MAE")} FROM m',
    "a_predictions": f"{NAIVE} SELECT series, dt, {r('y_true', 'week', 'month', digits=5)} FROM nv WHERE fold = 0",
    "a_graph_export": f"{PAIRS}, nd AS (SELECT snapshot, count(*) AS n_nodes, string_agg(src, ',' ORDER BY src) AS nodes FROM nodes GROUP BY 1), ne AS (SELECT snapshot, count(*) AS n_edges FROM ed WHERE src < dst GROUP BY 1) SELECT snapshot, n_nodes, coalesce(n_edges, 0) AS n_edges, round(avg(abs(rho)), 6) + 0.0 AS avg_abs_corr, nodes, '{K}' AS k FROM nd LEFT JOIN ne USING (snapshot) JOIN p USING (snapshot) GROUP BY ALL",
    "a_graph_edges": f"{PAIRS} SELECT snapshot, src AS source, dst AS target, round(round(d, 6), 5) + 0.0 AS weight FROM ed WHERE src < dst",
    "a_feature_export": f"{PAIRS}, {ASOF} SELECT series, strftime(dt, '%Y-%m-%d') AS date, degree AS net_degree, CASE WHEN turnover <> 0 THEN round(turnover, 6) + 0.0 END AS net_turnover FROM ao WHERE series IN ('Brand#1', 'Brand#2', 'Brand#3')",
    "a_ablation_table": c.ORACLES["g_ablation_distance"],
    "b_complete_rows": f'{PANEL} SELECT series, dt, {r("log_RV22", "log_Y")} FROM x WHERE "log_RV1" IS NOT NULL AND "log_RV5" IS NOT NULL AND "log_RV22" IS NOT NULL AND "log_Y" IS NOT NULL',
    "b_index_market": further.REALISED + """, j AS (SELECT a.series, a.dt, 100 * b.r AS "Market_Returns", b.rv AS m2 FROM rl a LEFT JOIN rl b ON a.dt = b.dt AND b.series = 'view'),
k AS (SELECT *, CASE WHEN count(m2) OVER w5 = 5 THEN avg(m2) OVER w5 END AS "Market_RV5", CASE WHEN count(m2) OVER w22 = 22 THEN avg(m2) OVER w22 END AS "Market_RV22" FROM j WINDOW w5 AS (PARTITION BY series ORDER BY dt ROWS 4 PRECEDING), w22 AS (PARTITION BY series ORDER BY dt ROWS 21 PRECEDING))
SELECT series, dt, round("Market_Returns", 5) + 0.0 AS "Market_Returns", round("Market_RV5", 5) + 0.0 AS "Market_RV5", round("Market_RV22", 5) + 0.0 AS "Market_RV22", round(ln("Market_RV5" + 1e-8), 5) + 0.0 AS "log_Market_RV5", round(ln("Market_RV22" + 1e-8), 5) + 0.0 AS "log_Market_RV22" FROM k""",
    "b_har_panel": f"{PANEL}, {_MARKET} SELECT series, dt, {_HAR} FROM mf WHERE {_WHOLE} QUALIFY count(*) OVER (PARTITION BY series) >= 2",
    "b_custom_preprocess": f'{PANEL} SELECT series, count(*) AS n, round(avg("Returns_Lag_5"), 6) + 0.0 AS mean_rise FROM ret WHERE "Returns_Lag_5" > 0 GROUP BY 1',
    "b_spike_labels_lookback": PANEL + """, y AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt DESC) AS n FROM x WHERE "Y_fwd" IS NOT NULL), t AS (SELECT series, quantile_cont("Y_fwd", 0.75) AS th FROM y WHERE n <= 756 GROUP BY 1)
SELECT series, dt, round(th, 6) + 0.0 AS threshold, CAST("Y_fwd" > th AS BIGINT) AS spike FROM y JOIN t USING (series)""",
    "c_custom_distance": f"{PAIRS} SELECT snapshot, s1, s2, {r('rho', digits=5)}, round(sqrt(2 * (1 - rho)), 5) + 0.0 AS d FROM p",
    "c_saved_signs": PAIRS + """, od AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) - 1 AS o FROM (SELECT DISTINCT snapshot FROM p)), so AS (SELECT a.snapshot, b.snapshot AS saved FROM od a JOIN od b ON b.o = a.o - a.o % 5)
SELECT ed.snapshot, ed.src, ed.dst, round(ed.d, 6) + 0.0 AS d, round(p.rho, 6) + 0.0 AS rho FROM ed JOIN so ON so.snapshot = ed.snapshot LEFT JOIN p ON p.snapshot = so.saved AND p.s1 = least(ed.src, ed.dst) AND p.s2 = greatest(ed.src, ed.dst)""",
    "d_global_clustering": f"{PAIRS}, {LOCAL} SELECT snapshot, round(avg(clustering), 6) + 0.0 AS clustering FROM lc GROUP BY 1",
    "d_graph_features": PAIRS + f""", {TURN}, {LOCAL}, gc AS (SELECT snapshot, avg(clustering) AS g FROM lc GROUP BY 1), aa AS (SELECT snapshot, avg(abs(rho)) AS a FROM p GROUP BY 1),
vv AS (SELECT series, i, {", ".join(f'last_value("{v}" IGNORE NULLS) OVER w AS "{v}"' for v in network.VALUES)} FROM x WINDOW w AS (PARTITION BY series ORDER BY i)),
nb AS (SELECT ed.*, 1 / greatest(d, 1e-8) AS w, row_number() OVER (PARTITION BY snapshot, src ORDER BY round(d, 9), dst) - 1 AS q, {", ".join(f'"{v}"' for v in network.VALUES)} FROM ed JOIN vv ON vv.i = ed.snapshot AND vv.series = ed.dst),
na AS (SELECT snapshot, src, {_IDW}, {_NN} FROM nb GROUP BY 1, 2)
SELECT tu.snapshot, tu.src, tu.degree AS net_degree, round(turnover, 4) + 0.0 AS net_degree_change, round(clustering, 4) + 0.0 AS net_node_clustering, round(g, 4) + 0.0 AS net_global_clustering, round(a, 4) + 0.0 AS net_avg_abs_corr, na.* EXCLUDE (snapshot, src) FROM tu JOIN lc USING (snapshot, src) JOIN gc USING (snapshot) JOIN aa USING (snapshot) LEFT JOIN na ON na.snapshot = tu.snapshot AND na.src = tu.src""",
    "d_network_panel": PAIRS + """, nb AS (SELECT ed.snapshot, src, sum("log_RV5" / greatest(d, 1e-8)) / sum(CASE WHEN "log_RV5" IS NOT NULL THEN 1 / greatest(d, 1e-8) END) AS v FROM ed JOIN x ON x.i = ed.snapshot AND x.series = ed.dst GROUP BY 1, 2),
nf AS (SELECT deg.snapshot, deg.src, degree, v FROM deg LEFT JOIN nb USING (snapshot, src))
SELECT series, dt, last_value(degree IGNORE NULLS) OVER w AS net_degree, round(last_value(v IGNORE NULLS) OVER w, 5) + 0.0 AS "net_idw_log_RV5" FROM wk LEFT JOIN nf ON nf.snapshot = wk.i AND nf.src = wk.series WINDOW w AS (PARTITION BY series ORDER BY dt)""",
    "d_features_on_dates": f"{PAIRS}, {ASOF} SELECT series, dt, degree FROM ao WHERE dt IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')",
    "d_degree_table": PAIRS + " SELECT snapshot, " + ", ".join(f"max(degree) FILTER (src = '{s}') AS \"{s}\"" for s in SERIES) + " FROM deg GROUP BY 1",
    "e_task_grid": PANEL + "," + c._folds("ret", 2) + "SELECT series, CAST(fold AS BIGINT) AS fold, category, model FROM (SELECT DISTINCT series, fold FROM fo), (VALUES " + ", ".join([f"('HAR', '{n}')" for n in _NAMES] + [f"('RegimeSwitching', '{n}')" for n in _REGIMES]) + ") t(category, model)",
    "e_filled_network": f"{PAIRS}, {ASOF} SELECT series, dt, coalesce(degree, 0) AS net_degree, round(coalesce(turnover, 0), 6) + 0.0 AS net_degree_change FROM ao",
    "e_merged_predictions": NAIVE.replace("nv AS (", "nv AS MATERIALIZED (") + f""", mo2 AS (SELECT * FROM nv WHERE fold = 1 AND dt >= DATE '2000-01-01') SELECT coalesce(a.series, b.series) AS series, coalesce(a.dt, b.dt) AS dt, round(coalesce(b.y_true, a.y_true), 5) + 0.0 AS y_true, round(a.week, 5) + 0.0 AS week, round(b.month, 5) + 0.0 AS month FROM nv a FULL JOIN mo2 b ON a.series = b.series AND a.dt = b.dt""",
    "e_all_metrics": f'{METRICS} SELECT "Category", "Ticker", "Model", "Fold", {r("RMSE_log")} FROM m',
    "m_penalised": ROWS + """, st AS (SELECT series, count(*) AS n, avg("log_RV5") AS mx, avg("log_Y") AS my, stddev_pop("log_RV5") AS sx, covar_pop("log_RV5", "log_Y") AS sxy FROM tn GROUP BY 1),
b AS (SELECT series, 'ridge' AS penalty, n * sxy / sx / (n + 50.0) / sx AS slope, mx, my FROM st UNION ALL SELECT series, 'lasso', sign(sxy) * greatest(abs(sxy / sx) - 0.05, 0) / sx, mx, my FROM st)
SELECT series, penalty, round(slope, 5) + 0.0 AS slope, round(my - slope * mx, 5) + 0.0 AS intercept FROM b""",
    "m_har_three": ROWS + """, st AS (SELECT series, """ + ", ".join(f'covar_pop("{a}", "{b}") AS {n}' for n, a, b in (("a1", "log_RV1", "log_RV1"), ("a2", "log_RV1", "log_RV5"), ("a3", "log_RV1", "log_RV22"), ("b2", "log_RV5", "log_RV5"), ("b3", "log_RV5", "log_RV22"), ("c3", "log_RV22", "log_RV22"), ("y1", "log_RV1", "log_Y"), ("y2", "log_RV5", "log_Y"), ("y3", "log_RV22", "log_Y")))
    + ', avg("log_RV1") AS m1, avg("log_RV5") AS m2, avg("log_RV22") AS m3, avg("log_Y") AS my FROM tn GROUP BY 1), s3 AS (SELECT *, a2 AS b1, a3 AS c1, b3 AS c2 FROM st), '
    + f"dt3 AS (SELECT *, {_DET.format(a='a', b='b', c='c')} AS de, {_DET.format(a='y', b='b', c='c')} AS d1, {_DET.format(a='a', b='y', c='c')} AS d2, {_DET.format(a='a', b='b', c='y')} AS d3 FROM s3) "
    + "SELECT series, round(d1 / de, 4) + 0.0 AS b1, round(d2 / de, 4) + 0.0 AS b2, round(d3 / de, 4) + 0.0 AS b3, round(my - d1 / de * m1 - d2 / de * m2 - d3 / de * m3, 4) + 0.0 AS intercept FROM dt3",
    "m_regimes": ROWS + """, q AS (SELECT series, quantile_cont("log_RV22", 0.9) AS cut FROM tn GROUP BY 1), pt AS (SELECT tn.*, 'all' AS part FROM tn UNION ALL SELECT tn.*, CASE WHEN "log_RV22" > cut THEN '0.9/1' ELSE '0.9/0' END FROM tn JOIN q USING (series))
SELECT series, part, count(*) AS n, round(regr_slope("log_Y", "log_RV5"), 5) + 0.0 AS slope, round(regr_intercept("log_Y", "log_RV5"), 5) + 0.0 AS intercept FROM pt GROUP BY 1, 2""",
    "m_two_stages": PAIRS + """, nf AS (SELECT x.*, coalesce(last_value(degree IGNORE NULLS) OVER (PARTITION BY x.series ORDER BY dt), 0) AS net FROM x LEFT JOIN deg ON deg.snapshot = x.i AND deg.src = x.series),
xx AS (SELECT * FROM nf WHERE "log_RV5" IS NOT NULL AND "log_RV22" IS NOT NULL AND "log_Y" IS NOT NULL),""" + c._folds("xx", 1) + """, s1 AS (SELECT series, regr_slope("log_Y", "log_RV5") AS b, regr_intercept("log_Y", "log_RV5") AS a FROM fo WHERE role = 'train' GROUP BY 1),
rs AS (SELECT fo.series, net, "log_Y" - a - b * "log_RV5" AS e FROM fo JOIN s1 USING (series) WHERE role = 'train'), s2 AS (SELECT series, count(*) AS n, avg(net) AS mn, covar_pop(net, e) AS c, var_pop(net) AS v FROM rs GROUP BY 1)
SELECT series, dt, round(a + b * "log_RV5" + least(greatest((net - mn) * n * c / (v * (n + 10.0)), -0.01), 0.01), 5) + 0.0 AS log_pred FROM fo JOIN s1 USING (series) JOIN s2 USING (series) WHERE role = 'test'""",
    "m_variance_filter": PANEL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", q AS (SELECT series, dt, "RV1" AS r2, row_number() OVER (PARTITION BY series ORDER BY dt) AS j FROM x WHERE "Returns" IS NOT NULL), ms AS (SELECT series, avg(r2) AS s FROM q GROUP BY 1),
rc AS (SELECT series, 1 AS j, s, {GARCH[0]} * s + {GARCH[1]} * s + {GARCH[2]} * s AS h FROM ms UNION ALL SELECT rc.series, rc.j + 1, rc.s, {GARCH[0]} * rc.s + {GARCH[1]} * q.r2 + {GARCH[2]} * rc.h FROM rc JOIN q ON q.series = rc.series AND q.j = rc.j WHERE rc.j < (SELECT max(j) FROM q))
SELECT series, dt, round(h, 4) + 0.0 AS variance FROM rc JOIN q USING (series, j)""",
    "g_display_scale": f'{METRICS} SELECT "Category", "Ticker", "Model", "Fold", round("RMSE" * 10000, 3) + 0.0 AS "RMSE", round("MAE" * 10000, 3) + 0.0 AS "MAE" FROM m',
    "g_spike_summary": CLF_SUMMARY + ' SELECT "Category", "Model", ' + _rounded([f"mean_{n}" for n in _SCORES] + ["median_ROC_AUC"], 6) + ", n_tickers FROM s",
    "g_leaderboard": METRICS + """, w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round(mean_RMSE_log, 9), "Model") = 1) SELECT row_number() OVER (ORDER BY round(mean_RMSE_log, 9), "Category") AS place, "Category", "Model", round(mean_RMSE_log, 6) + 0.0 AS "mean_RMSE_log" FROM w""",
    "g_spike_leaderboard": CLF_SUMMARY + """, w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round("mean_ROC_AUC", 9) DESC NULLS LAST, "Model") = 1) SELECT row_number() OVER (ORDER BY round("mean_ROC_AUC", 9) DESC NULLS LAST, "Category") AS place, "Category", "Model", round("mean_ROC_AUC", 6) + 0.0 AS "mean_ROC_AUC" FROM w""",
    "g_signed_rank_p": METRICS.replace("WITH ", "WITH RECURSIVE ", 1) + NET + SIGNED + """, dp AS (SELECT 0 AS r, list_transform(range(326), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w UNION ALL SELECT r + 1, list_transform(w, lambda x, i: x + CASE WHEN i > r + 1 THEN w[i - r - 1] ELSE 0 END) FROM dp, t WHERE r < n), fin AS (SELECT w FROM dp, t WHERE r = n)
SELECT t.*, u.*, round(least(1, 2 * list_sum(w[1:CAST(least(w_plus, w_minus) AS INTEGER) + 1]) / 2.0 ** n), 6) + 0.0 AS p_two_sided, round(list_sum(w[1:CAST(w_plus AS INTEGER) + 1]) / 2.0 ** n, 6) + 0.0 AS p_one_sided FROM t, u, fin""",
    "g_spike_signed_rank": CLF + """, b AS (SELECT "Category", "Ticker", "Model", avg("ROC_AUC") AS v FROM m GROUP BY 1, 2, 3), mm AS (SELECT "Category", "Model", avg(v) AS mm, "Category" LIKE '%[k=%' AS net FROM b GROUP BY 1, 2),
win AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY net ORDER BY round(mm, 9) DESC NULLS LAST, "Category", "Model") = 1), own AS (SELECT b.*, net FROM b JOIN win USING ("Category", "Model")),
pd AS (SELECT x."Ticker", y.v - x.v AS delta FROM own x JOIN own y ON x."Ticker" = y."Ticker" AND x.net AND NOT y.net)""" + SIGNED + " SELECT t.*, u.* FROM t, u",
    "g_weighting_breakdown": CLF + """, e AS (SELECT *, trim(regexp_replace("Category", '\\s*\\[k=\\d+\\]', '')) AS "Base" FROM m WHERE "Category" LIKE '%[k=%'), v AS (SELECT CASE WHEN "Base" LIKE 'PCorr%' THEN 'PCorr' WHEN "Base" LIKE 'MI%' THEN 'MI' ELSE 'SqCorr' END AS graph, CASE WHEN "Base" LIKE '%Learned%' THEN 'Learned' WHEN "Base" LIKE 'Exp%' THEN 'Exp' ELSE 'IDW' END AS weighting, "Model", avg("ROC_AUC") AS value FROM e GROUP BY 1, 2, 3)
SELECT graph, weighting, "Model", round(value, 6) + 0.0 AS value FROM v QUALIFY row_number() OVER (PARTITION BY graph, weighting ORDER BY round(value, 9) DESC NULLS LAST, "Model") = 1""",
    "g_structural_table": METRICS + f""", ax AS (SELECT "Category", "Model", {_AXES}, avg(rl) AS mean, median(rl) AS median, avg(CASE WHEN r2 > 0 THEN 1.0 ELSE 0.0 END) AS share_positive FROM (SELECT "Base", "Category", "Ticker", "Model", avg("RMSE_log") AS rl, avg("R2_log") AS r2 FROM e WHERE k IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY ALL)
SELECT distance, "Category", "Model", {r("mean", "median", "share_positive")} FROM ax QUALIFY row_number() OVER (PARTITION BY distance ORDER BY round(mean, 9), "Category", "Model") = 1""",
    "g_full_ablation": AXES + "".join(
        f""" {u} SELECT '{n}' AS "table", {"CAST(k AS BIGINT)" if "k" in own else "CAST(NULL AS BIGINT)"} AS k, {", ".join(a if a in own else f"CAST(NULL AS VARCHAR) AS {a}" for a in ("distance", "structure", "weighting"))}, "Category", "Model", round(value, 6) + 0.0 AS value FROM (SELECT * FROM ax QUALIFY {_TOP.format(", ".join(own))})"""
        for n, own, u in (("k_distance", ["distance", "k"], ""), ("structure_distance", ["structure", "distance"], "UNION ALL"), ("distance_structure", ["distance", "structure"], "UNION ALL"), ("weighting", ["weighting"], "UNION ALL"))
    ),
    "g_filtered_ablation": CLF + """, e AS (SELECT *, trim(regexp_replace("Category", '\\s*\\[k=\\d+\\]', '')) AS "Base" FROM m WHERE "Category" LIKE '%[k=%'), v AS (SELECT CASE WHEN "Base" LIKE '%Cluster%' THEN 'Clustering' ELSE 'Plain' END AS structure, "Category", "Model", avg("ROC_AUC") AS value FROM e WHERE "Base" NOT LIKE 'Exp%' GROUP BY 1, 2, 3)
SELECT structure, "Category", "Model", round(value, 6) + 0.0 AS value FROM v QUALIFY row_number() OVER (PARTITION BY structure ORDER BY round(value, 9) DESC NULLS LAST, "Category", "Model") = 1""",
    "g_best_per_value": AXES + """ SELECT 'k' AS axis, CAST(k AS VARCHAR) AS label, round(min(value), 6) + 0.0 AS value FROM ax GROUP BY 2 UNION ALL SELECT 'distance', distance, round(min(value), 6) + 0.0 FROM ax GROUP BY 2""",
    "g_prediction_curves": NAIVE + """, pl AS (SELECT series, dt, y_true, 'week' AS model, week AS y_pred FROM nv WHERE fold = 0 UNION ALL SELECT series, dt, y_true, 'month', month FROM nv WHERE fold = 0), sc AS (SELECT series, model, sqrt(avg((ln(greatest(y_true, 1e-8)) - ln(greatest(y_pred, 1e-8))) ** 2)) AS v FROM pl GROUP BY 1, 2), wn AS (SELECT series, model FROM sc QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(v, 9), model) = 1)
SELECT series, model, dt, round(2 * y_true, 4) + 0.0 AS y_true, round(2 * y_pred, 4) + 0.0 AS y_pred FROM pl JOIN wn USING (series, model) WHERE year(dt) = 2001""",
    "g_whole_report": METRICS + """, w0 AS (SELECT "Base", "Category" FROM (SELECT "Base", "Category", "Model", avg("R2") AS v FROM e GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY "Base" ORDER BY round(v, 9) DESC NULLS LAST, "Category", "Model") = 1),
w AS (SELECT * FROM s WHERE "Category" IN (SELECT "Category" FROM w0) QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round(mean_RMSE_log, 9), "Model") = 1) SELECT row_number() OVER (ORDER BY round(mean_RMSE_log, 9), "Category") AS place, "Category", "Model", round(mean_RMSE_log, 6) + 0.0 AS "mean_RMSE_log", n_tickers FROM w""",
    "h_date_slice": f"{PANEL} SELECT series, dt, {r('Returns')} FROM ret WHERE dt BETWEEN DATE '1998-03-01' AND DATE '1999-02-28'",
    "h_common_autocorrelation": c.ORACLES["h_autocorrelation"].replace("BETWEEN 1 AND 10", "BETWEEN 1 AND 20").replace("round(1.96 / sqrt(n), 6)", "round(1.96 / sqrt((SELECT min(n) FROM t)), 6)"),
    "h_sigma_outliers": PANEL + """, cu AS (SELECT series, avg("Returns") - 2 * stddev_samp("Returns") AS lo, avg("Returns") + 2 * stddev_samp("Returns") AS hi FROM ret GROUP BY 1)
SELECT series, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high, count(*) FILTER ("Returns" <= lo) AS n_low, count(*) FILTER ("Returns" >= hi) AS n_high, count(*) AS n, round((count(*) FILTER ("Returns" <= lo) + count(*) FILTER ("Returns" >= hi)) / count(*), 6) + 0.0 AS share FROM ret JOIN cu USING (series) WHERE "Returns" IS NOT NULL GROUP BY series, lo, hi""",
}
