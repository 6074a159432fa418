"""Queries that fit and score the catalogue over graphs, and reports on their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide import catalog as c
from voltide import further, studies
from voltide.catalog import K, METRICS, PAIRS, STEP, TEST, TRAIN, rounded
from voltide.functions import features as fx
from voltide.operators import forecasting, reports, spikes
from voltide.operators import graphs as gr
from voltide.sources import files, panels
from voltide.sources.store import new_folder, written

GRAPHS = [(kind, k) for kind in gr.KINDS for k in range(1, gr.MOST + 1)]


def graph_arrays(spark, d, graphs):
    """The panel with own and market columns, and the arrays of the graphs' features."""
    sold = panels.totals(spark, d)
    panel = written(c.panel(spark, d, sold=sold))
    values = written(fx.market_features(fx.variance_features(panel), panels.market(spark, d, sold=sold)))
    kinds, ks = tuple(dict.fromkeys(kind for kind, _ in graphs)), tuple(sorted({k for _, k in graphs}))
    pairs = written(gr.distances(panel, kinds, c.WINDOW, STEP))
    edges = written(gr.all_edges(gr.levelled(pairs), pairs, ks, stride=5))
    features = gr.all_features(pairs, edges, values, ks, STEP)
    return values, written(gr.packed(features, values, graphs, STEP), pairs, edges)


def _evaluation(spark, d, graphs, models=None, **more):
    values, nets = graph_arrays(spark, d, graphs)
    return gr.Evaluation(values, nets, models or gr.catalogue(graphs), 1, TEST, TRAIN, STEP, **more)


def m_network_evaluation(spark, d):
    """All 2,163 linear models, over four kinds of graphs with one to five neighbours."""
    return rounded(_evaluation(spark, d, GRAPHS).metrics())


def _two_stages(k):
    return [forecasting.Model(f"V [k={k}]", "two", ("log_RV5",), net=("net_degree",), stage2=10.0, bound=0.01)]


def m_two_graphs(spark, d):
    """A model without a graph, and residual corrections by the degrees of two graphs, from one matrix."""
    own = {"": [forecasting.Model("HAR", "one", ("log_RV5",))], "sqcorr/1": _two_stages(1), "sqcorr/5": _two_stages(5)}
    run = _evaluation(spark, d, [("sqcorr", 1), ("sqcorr", 5)], own, own=["log_RV5"])
    preds = run.predictions([m for its in own.values() for m in its])
    return rounded(preds.select("series", "dt", "category", F.log("y_pred").alias("log_pred")), 5)


def _without_graphs(panel):
    return panel.where(F.col("i") % STEP == 0).select("series", F.col("i").alias("snapshot"), F.array().cast("array<double>").alias("net"))


def _regimes(spark, d, **more):
    values = written(c.featured(spark, d))
    return gr.Evaluation(values, _without_graphs(values), {"": [forecasting.Model("R", "one", ("log_RV5",), regime=0.9)]}, 1, TEST, TRAIN, STEP, own=["log_RV5"], **more)


def m_regimes(spark, d):
    """Slopes of one column by regime, and of all rows, the fallback."""
    return rounded(_regimes(spark, d).fitted.select("series", "part", "n", F.element_at("coef", 1).alias("slope"), "intercept"), 5)


def m_regime_predictions(spark, d):
    """Forecasts by the regime of each test row, of slopes learned by regime."""
    run = _regimes(spark, d)
    return rounded(run.predictions(run.models[""]).select("series", "dt", F.log("y_pred").alias("log_pred")), 5)


def m_two_stages(spark, d):
    """A residual correction by the degree, cut at 0.01, and the sum of both stages."""
    own = {"sqcorr/5": _two_stages(5)}
    run = _evaluation(spark, d, [("sqcorr", 5)], own, own=["log_RV5"])
    return rounded(run.predictions(own["sqcorr/5"]).select("series", "dt", F.log("y_pred").alias("log_pred")), 5)


def m_scaler_parameters(spark, d):
    """Means, scales and thresholds of a regime model, exported as documents and read back."""
    run = _regimes(spark, d, params=True)
    path = new_folder(spark)
    files.write_parameters(run.parameters(), path)
    return rounded(files.parameters(spark, path).where("kind in ('mean', 'scale', 'threshold', 'intercept', 'coef')").select("series", "part", "kind", "name", "value"), 4)


def m_parameters(spark, d):
    """Everything that all linear models of one graph have learned, zero coefficients included."""
    run = _evaluation(spark, d, [("sqcorr", K)], params=True)
    path = new_folder(spark)
    files.write_parameters(run.parameters(), path)
    return rounded(files.parameters(spark, path))


def _study(spark, d, **more):
    values, nets = graph_arrays(spark, d, [("sqcorr", K)])
    return spikes.Study(values, nets, spikes.catalogue([("sqcorr", K)]), 1, TEST, TRAIN, step=STEP, **more)


def _spike_scores(preds):
    keys = ["category", "model", "series", "fold"]
    return reports.classification_metrics(preds, keys).join(reports.weighted_recall(preds, keys), keys)


def m_spike_evaluation(spark, d):
    """All logits of one graph: their scores by series and fold."""
    return rounded(_spike_scores(_study(spark, d).predictions()))


def m_spike_parameters(spark, d):
    path = new_folder(spark)
    files.write_parameters(_study(spark, d).parameters(), path)
    return rounded(files.parameters(spark, path))


def a_spike_predictions(spark, d):
    """The store of predicted spikes, with labels and odds, written by series and read back."""
    path = new_folder(spark)
    own = {"": [m for m in spikes.baselines() if m.name in ("HAR-Logit (C=1.0)", "RegHAR-Logit (p75)")]}
    values = written(c.with_market(spark, d))
    study = spikes.Study(values, _without_graphs(values), own, 1, TEST, TRAIN, 0.75, 756, step=STEP)
    files.write_predictions(study.predictions(), path)
    return rounded(spark.read.parquet(path).select("series", "dt", "category", "model", "y_true", "label", "pred", "proba"), 5)


def _as_results(metrics):
    return metrics.withColumnsRenamed({"category": "Category", "model": "Model", "series": "Ticker", "fold": "Fold"})


def g_evaluation_report(spark, d):
    """From the fits to the tables: results of two kinds of graphs are saved, read back and reported."""
    run = _evaluation(spark, d, [(kind, k) for kind in ("sqcorr", "exp") for k in (1, 3)])
    path = new_folder(spark)
    files.write_results(_as_results(run.metrics()), path)
    tables = reports.whole_report(files.results(spark, path))
    return rounded(tables["leaderboard"].select("place", "Category", "Model", "mean_RMSE_log", "n_tickers"))


def m_index_evaluation(spark, d):
    """The study of indices: the same catalogue without market columns."""
    graphs = [("sqcorr", 3), ("mi", 3)]
    own = [c_ for c_ in gr.OWN if c_ not in forecasting.MARKET]
    return rounded(_evaluation(spark, d, graphs, gr.catalogue(graphs, market=False), own=own).metrics())


def m_index_spikes(spark, d):
    """The logits of the study of indices: no market columns, spikes beyond the 75 % quantile of the last
    756 training rows."""
    graphs = [("sqcorr", 3)]
    values, nets = graph_arrays(spark, d, graphs)
    own = [c_ for c_ in gr.OWN if c_ not in forecasting.MARKET]
    study = spikes.Study(values, nets, spikes.catalogue(graphs, market=False), 1, TEST, TRAIN, 0.75, 756, step=STEP, own=own)
    return rounded(_spike_scores(study.predictions()))


def g_floor(spark, d):
    """Rows whose R2 is below the floor, of which the results here have some, are left out."""
    rows = panels.metrics(spark, d).withColumn("R2", F.when(F.col("R2") < 0, F.col("R2") * 1e9).otherwise(F.col("R2")))
    return rounded(reports.clip_extremes(rows).select("Category", "Ticker", "Model", "Fold", "R2", "R2_log"))


def _report(spark, d):
    path = new_folder(spark)
    files.write_results(panels.metrics(spark, d), path)
    return reports.whole_report(files.results(spark, path))


def g_report_per_ticker(spark, d):
    return rounded(_report(spark, d)["per_ticker"])


def g_report_k_breakdown(spark, d):
    return rounded(_report(spark, d)["k_breakdown"])


def _spike_report(spark, d):
    path = new_folder(spark)
    files.write_results(panels.spike_metrics(spark, d), path)
    return reports.whole_spike_report(files.results(spark, path, files.SPIKES))


def g_spike_report(spark, d):
    """The report on saved scores of spikes, to the leaderboard of the best k."""
    return rounded(_spike_report(spark, d)["leaderboard"].select("place", "Category", "Model", "mean_ROC_AUC", "n_tickers"))


def a_spike_results(spark, d):
    """The store of spike scores, written and read back."""
    path = new_folder(spark)
    files.write_results(panels.spike_metrics(spark, d), path)
    return rounded(files.results(spark, path, files.SPIKES).select("Category", "Ticker", "Model", "Fold", "ROC_AUC", "F1", "Recall"))


QUERIES = {f.__name__: f for f in (m_network_evaluation, m_two_graphs, m_two_stages, m_regimes, m_regime_predictions, m_scaler_parameters, m_parameters, m_spike_evaluation, m_spike_parameters, a_spike_predictions, g_evaluation_report, m_index_evaluation, m_index_spikes, g_floor, g_report_per_ticker, g_report_k_breakdown, g_spike_report, a_spike_results)}


def _two_sql(k):
    pairs = PAIRS.replace(f"dst) <= {K})", f"dst) <= {k})")
    return studies.ORACLES["m_two_stages"].replace(PAIRS, pairs).replace("SELECT series, dt, round(", f"SELECT series, dt, 'V [k={k}]' AS category, round(")


_ONE = studies.ROWS.replace(", tn AS", ", st AS (SELECT series, regr_slope(\"log_Y\", \"log_RV5\") AS b, regr_intercept(\"log_Y\", \"log_RV5\") AS a FROM fo WHERE role = 'train' GROUP BY 1), tn AS").replace('"log_RV1" IS NOT NULL AND ', "")
_PARTS = studies.ROWS.replace('"log_RV1" IS NOT NULL AND ', "") + """, q AS (SELECT series, quantile_cont("log_RV22", 0.9) AS cut FROM tn GROUP BY 1),
pt AS (SELECT tn.*, 'all' AS part FROM tn UNION ALL SELECT tn.*, CASE WHEN "log_RV22" > cut THEN '0.9/1' ELSE '0.9/0' END FROM tn JOIN q USING (series)),
sl AS (SELECT series, part, count(*) AS n, regr_slope("log_Y", "log_RV5") AS b, regr_intercept("log_Y", "log_RV5") AS a, avg("log_RV5") AS m, stddev_pop("log_RV5") AS s, avg("log_Y") AS y FROM pt GROUP BY 1, 2)"""

_BEST_K = """, w0 AS (SELECT "Base", "Category" FROM (SELECT "Base", "Category", "Model", avg("{0}") AS v FROM e GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY "Base" ORDER BY round(v, 9) DESC NULLS LAST, "Category", "Model") = 1)"""

ORACLES = {
    "g_floor": METRICS + """, f AS (SELECT * REPLACE (CASE WHEN "R2" < 0 THEN "R2" * 1e9 ELSE "R2" END AS "R2") FROM m) SELECT "Category", "Ticker", "Model", CAST("Fold" AS BIGINT) AS "Fold", round("R2", 6) + 0.0 AS "R2", round("R2_log", 6) + 0.0 AS "R2_log" FROM f WHERE "R2" > -1e6 AND "R2_log" > -1e6""",
    "g_report_per_ticker": further.ORACLES["g_per_ticker"].replace(METRICS, METRICS + _BEST_K.format("R2")).replace("FROM b GROUP BY 1, 2)", "FROM b WHERE \"Category\" IN (SELECT \"Category\" FROM w0) GROUP BY 1, 2)"),
    "g_report_k_breakdown": c.ORACLES["g_k_breakdown"],
    "g_spike_report": studies.CLF_SUMMARY + ", e AS (SELECT *, trim(regexp_replace(\"Category\", '\\s*\\[k=\\d+\\]', '')) AS \"Base\" FROM m)" + _BEST_K.format("ROC_AUC") + """, w AS (SELECT * FROM s WHERE "Category" IN (SELECT "Category" FROM w0) QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round("mean_ROC_AUC", 9) DESC NULLS LAST, "Model") = 1)
SELECT row_number() OVER (ORDER BY round("mean_ROC_AUC", 9) DESC NULLS LAST, "Category") AS place, "Category", "Model", round("mean_ROC_AUC", 6) + 0.0 AS "mean_ROC_AUC", n_tickers FROM w""",
    "a_spike_results": studies.CLF + """ SELECT "Category", "Ticker", "Model", CAST("Fold" AS BIGINT) AS "Fold", round("ROC_AUC", 6) + 0.0 AS "ROC_AUC", round("F1", 6) + 0.0 AS "F1", round("Recall", 6) + 0.0 AS "Recall" FROM m""",
    "m_two_graphs": f"SELECT * FROM ({_ONE} SELECT series, dt, 'HAR' AS category, round(a + b * \"log_RV5\", 5) + 0.0 AS log_pred FROM fo JOIN st USING (series) WHERE role = 'test') UNION ALL SELECT * FROM ({_two_sql(1)}) UNION ALL SELECT * FROM ({_two_sql(5)})",
    "m_regime_predictions": _PARTS + """ SELECT fo.series, dt, round(CASE WHEN r.n >= 30 THEN r.a + r.b * "log_RV5" ELSE w.a + w.b * "log_RV5" END, 5) + 0.0 AS log_pred FROM fo JOIN q USING (series) JOIN sl w ON w.series = fo.series AND w.part = 'all'
LEFT JOIN sl r ON r.series = fo.series AND r.part = CASE WHEN "log_RV22" > cut THEN '0.9/1' ELSE '0.9/0' END WHERE role = 'test'""",
    "m_scaler_parameters": _PARTS + """ SELECT series, part, 'mean' AS kind, 'log_RV5' AS name, round(m, 4) + 0.0 AS value FROM sl UNION ALL SELECT series, part, 'scale', 'log_RV5', round(s, 4) + 0.0 FROM sl UNION ALL SELECT series, part, 'coef', 'log_RV5', round(b * s, 4) + 0.0 FROM sl
UNION ALL SELECT series, part, 'intercept', '', round(y, 4) + 0.0 FROM sl UNION ALL SELECT series, 'all', 'threshold', 'log_RV22', round(cut, 4) + 0.0 FROM q""",
}
