"""More queries over the reference capabilities, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide import catalog as c
from voltide.catalog import K, METRICS, NET, PAIRS, PANEL, STEP, TEST, TRAIN, WINDOW, r, rounded
from voltide.functions import features as fx
from voltide.operators import eda, network, reports
from voltide.sources import panels

CENTRE = "Brand#1"


def held(spark, d):
    return network.windows(c.panel(spark, d), WINDOW, STEP)


def knn(spark, d, k=K):
    return network.knn_edges(c.pairs(spark, d), k)


def b_realised_panel(spark, d):
    return rounded(panels.realised(spark, d))


def b_realised_features(spark, d):
    rows = fx.fill_and_keep(panels.realised(spark, d), ["rv", "r", "closeprice"])
    return rounded(fx.realised_features(rows).drop("rv", "r", "closeprice"), 5)


def c_rank_bins(spark, d):
    return rounded(network.rank_bins(held(spark, d)).groupBy("snapshot", "series", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i")))


def c_mutual_information(spark, d):
    return rounded(network.mutual_information(held(spark, d)))


def c_market_partial_correlation(spark, d):
    return rounded(network.market_partial(held(spark, d)))


def d_rank_features(spark, d):
    sold = panels.totals(spark, d)
    return rounded(network.rank_features(network.knn_edges(c.pairs(spark, d, sold), K), c.featured(spark, d, sold=sold), "log_RV5", K), 5)


def d_edge_counts(spark, d):
    return rounded(network.edge_counts(knn(spark, d)))


def d_mean_degree(spark, d):
    p, e = c.graph(spark, d)
    return rounded(network.degrees(network.nodes(p), e).groupBy("snapshot").agg(F.avg("degree").alias("mean_degree")))


def d_ego_network(spark, d):
    return rounded(network.ego(c.graph(spark, d)[1], CENTRE, K))


def d_neighbourhood_change(spark, d):
    return network.neighbourhood_change(c.graph(spark, d)[1])


def d_as_of(spark, d):
    sold = panels.totals(spark, d)
    p, e = c.graph(spark, d, sold=sold)
    return rounded(network.as_of(c.panel(spark, d, sold=sold), network.turnover(e, network.nodes(p), STEP), ["degree", "turnover"]))


def e_standardised(spark, d):
    rows = fx.folds(c.featured(spark, d).dropna(subset=["log_RV1", "log_RV22"]), 2, TEST, TRAIN)
    return rounded(fx.standardise(rows, ["log_RV1", "log_RV22"], ["series", "fold"]).select("series", "dt", "fold", "role", "log_RV1", "log_RV22"))


def f_weighted_recall(spark, d):
    rows = fx.spike_labels(c.featured(spark, d).dropna(subset=["RV5", "Y_fwd"]))
    return rounded(reports.weighted_recall(rows.select("series", F.col("Y_fwd").alias("y_true"), F.col("spike").alias("label"), (F.round(5 * F.col("RV5"), 6) > F.round("threshold", 6)).cast("int").alias("pred")), ["series"]))


def g_per_ticker(spark, d):
    return rounded(reports.per_ticker(panels.metrics(spark, d)))


def g_summary_without_outliers(spark, d):
    return rounded(reports.summarize(reports.without_outlying_tickers(panels.metrics(spark, d), 0.18)))


def g_ticker_winners(spark, d):
    p = reports.paired_differences(panels.metrics(spark, d))
    return rounded(p.withColumn("winner", F.when(F.round("delta", 9) < 0, "network").otherwise("baseline")))


def g_extremes(spark, d):
    return rounded(reports.extremes(reports.paired_differences(panels.metrics(spark, d))).select("favours", "place", "Ticker", "delta"))


def g_chosen_on_validation(spark, d):
    return rounded(reports.select_on_validation(panels.metrics(spark, d), 1))


def g_test_report(spark, d):
    return rounded(reports.report_on_test(panels.metrics(spark, d), 1, 0))


def g_baseline_and_network(spark, d):
    return rounded(reports.baseline_and_network(panels.metrics(spark, d)))


def h_histogram(spark, d):
    return rounded(eda.histogram(c.panel(spark, d)), 5)


QUERIES = {f.__name__: f for f in (
    b_realised_panel, b_realised_features, c_rank_bins, c_mutual_information, c_market_partial_correlation, d_rank_features, d_edge_counts, d_mean_degree,
    d_ego_network, d_neighbourhood_change, d_as_of, e_standardised, f_weighted_recall, g_per_ticker, g_summary_without_outliers, g_ticker_winners,
    g_extremes, g_chosen_on_validation, g_test_report, g_baseline_and_network, h_histogram,
)}

REALISED = """WITH ev AS (SELECT event_type AS series, date_trunc('hour', ts) AS dt, ts, event_id, CAST(value AS DOUBLE) AS v FROM events WHERE value > 0),
st AS (SELECT *, ln(v) - ln(lag(v) OVER (PARTITION BY series, dt ORDER BY ts, event_id)) AS step FROM ev),
rl AS (SELECT series, dt, sum(step ** 2) AS rv, ln(last(v ORDER BY ts, event_id) / first(v ORDER BY ts, event_id)) AS r, last(v ORDER BY ts, event_id) AS closeprice FROM st GROUP BY 1, 2)"""
BINS = PAIRS + """, bi AS (SELECT snapshot, series, i, CAST(floor((row_number() OVER (PARTITION BY snapshot, series ORDER BY round(r, 9), i) - 1) * 10 / count(*) OVER (PARTITION BY snapshot, series)) AS BIGINT) AS bin FROM h2),
en AS (SELECT snapshot, series, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT snapshot, series, bin, count(*) AS n FROM bi GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
CHOSEN = METRICS + """, ch AS (SELECT * FROM (SELECT "Category", "Model", median("RMSE_log") AS value FROM m WHERE "Fold" = 1 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round(value, 9), "Category", "Model") = 1)"""
SUMMARY = """SELECT "Category", "Model", round(avg("RMSE_log"), 6) + 0.0 AS mean_RMSE_log, round(median("RMSE_log"), 6) + 0.0 AS median_RMSE_log, round(avg("R2_log"), 6) + 0.0 AS mean_R2_log, round(avg(CASE WHEN "R2_log" > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_positive, count(DISTINCT "Ticker") AS n_tickers"""
MEANS = 'SELECT "Category", "Ticker", "Model", avg("RMSE_log") AS "RMSE_log", avg("R2_log") AS "R2_log" FROM m'
_NEAR = ", ".join(f'round(max(CASE WHEN k = {i} THEN "log_RV5" END), 5) + 0.0 AS "net_nn{i}_log_RV5", round(max(CASE WHEN k = {i} THEN d END), 5) + 0.0 AS net_nn{i}_dist' for i in range(K))

ORACLES = {
    "b_realised_panel": f'{REALISED} SELECT series, dt, {r("rv", "r", "closeprice")} FROM rl',
    "b_realised_features": REALISED + f""", n0 AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM rl),
ff AS (SELECT series, dt, last_value(rv IGNORE NULLS) OVER w AS rv, last_value(r IGNORE NULLS) OVER w AS r FROM n0 WHERE n >= 300 WINDOW w AS (PARTITION BY series ORDER BY dt)),
n1 AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM ff WHERE rv IS NOT NULL AND r IS NOT NULL),
q AS (SELECT series, dt, 100 * r AS "Returns", rv AS "RV1", CASE WHEN count(rv) OVER w5 = 5 THEN avg(rv) OVER w5 END AS "RV5", CASE WHEN count(rv) OVER w10 = 10 THEN avg(rv) OVER w10 END AS "RV10",
 CASE WHEN count(rv) OVER w5 = 5 THEN avg(CASE WHEN r < 0 THEN rv ELSE 0 END) OVER w5 END AS neg_semi_var5, CASE WHEN count(rv) OVER w5 = 5 THEN avg(CASE WHEN r >= 0 THEN rv ELSE 0 END) OVER w5 END AS pos_semi_var5, CASE WHEN count(rv) OVER w22 = 22 THEN avg(rv) OVER w22 END AS "RV22", CASE WHEN count(rv) OVER f5 = 5 THEN sum(rv) OVER f5 END AS "Y_fwd" FROM n1 WHERE n >= 300
 WINDOW w5 AS (PARTITION BY series ORDER BY dt ROWS 4 PRECEDING), w10 AS (PARTITION BY series ORDER BY dt ROWS 9 PRECEDING), w22 AS (PARTITION BY series ORDER BY dt ROWS 21 PRECEDING), f5 AS (PARTITION BY series ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
l AS (SELECT *, ln("RV10" + 1e-8) AS "log_RV10", ln(neg_semi_var5 + 1e-8) AS log_neg_semi5, ln(pos_semi_var5 + 1e-8) AS log_pos_semi5, ln("RV1" + 1e-8) AS "log_RV1", ln("RV5" + 1e-8) AS "log_RV5", ln("RV22" + 1e-8) AS "log_RV22", ln("Y_fwd" + 1e-8) AS "log_Y" FROM q)
SELECT series, dt, {r("Returns", "RV1", "RV5", "RV10", "RV22", "neg_semi_var5", "pos_semi_var5", "Y_fwd", "log_RV1", "log_RV5", "log_RV10", "log_RV22", "log_neg_semi5", "log_pos_semi5", "log_Y", digits=5)} FROM l""",
    "c_rank_bins": f"{BINS} SELECT snapshot, series, bin, count(*) AS n, CAST(sum(i) AS BIGINT) AS sum_i FROM bi GROUP BY 1, 2, 3",
    "c_mutual_information": BINS + f""", jo AS (SELECT a.snapshot, a.series AS s1, b.series AS s2, count(*) AS n FROM bi a JOIN bi b ON a.snapshot = b.snapshot AND a.i = b.i AND a.series < b.series GROUP BY 1, 2, 3, a.bin, b.bin),
je AS (SELECT snapshot, s1, s2, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM jo GROUP BY 1, 2, 3),
mi AS (SELECT je.snapshot, s1, s2, least(greatest(CASE WHEN sqrt(x.h * y.h) > 1e-10 THEN (x.h + y.h - je.h) / sqrt(x.h * y.h) ELSE 0 END, 0), 1) AS nmi FROM je JOIN en x ON x.snapshot = je.snapshot AND x.series = s1 JOIN en y ON y.snapshot = je.snapshot AND y.series = s2)
SELECT snapshot, s1, s2, round(nmi, 6) + 0.0 AS nmi, round(1 - nmi, 6) + 0.0 AS d FROM mi""",
    "c_market_partial_correlation": PAIRS + """, mt AS (SELECT snapshot, i, avg(r) AS y FROM h2 GROUP BY 1, 2), ow AS (SELECT snapshot, series, CASE WHEN var_pop(r) > 1e-12 AND var_pop(y) > 1e-12 THEN least(greatest(covar_pop(r, y) / sqrt(var_pop(r) * var_pop(y)), -1 + 1e-8), 1 - 1e-8) END AS m0 FROM h2 JOIN mt USING (snapshot, i) GROUP BY 1, 2),
om AS (SELECT snapshot, series, CASE WHEN bool_or(m0 IS NULL) OVER (PARTITION BY snapshot) THEN 0.0 ELSE m0 END AS m FROM ow),
pc AS (SELECT p.snapshot, s1, s2, least(greatest((rho - x.m * y.m) / sqrt(greatest(1 - x.m ** 2, 1e-10) * greatest(1 - y.m ** 2, 1e-10)), -1 + 1e-8), 1 - 1e-8) AS rho FROM p JOIN om x ON x.snapshot = p.snapshot AND x.series = s1 JOIN om y ON y.snapshot = p.snapshot AND y.series = s2)
SELECT snapshot, s1, s2, round(rho, 6) + 0.0 AS rho, round(1 - rho * rho, 6) + 0.0 AS d FROM pc""",
    "d_rank_features": PAIRS + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot, src ORDER BY round(d, 9), dst) - 1 AS k FROM ed)
SELECT snapshot, src, {_NEAR} FROM rk LEFT JOIN x ON x.i = rk.snapshot AND x.series = rk.dst WHERE k < {K} GROUP BY 1, 2""",
    "d_edge_counts": f"{PAIRS} SELECT snapshot, count(*) AS n_edges FROM ed WHERE src < dst GROUP BY 1",
    "d_mean_degree": f"{PAIRS} SELECT snapshot, round(avg(degree), 6) + 0.0 AS mean_degree FROM deg GROUP BY 1",
    "d_ego_network": PAIRS + f""", ne AS (SELECT snapshot, dst AS node FROM ed WHERE src = '{CENTRE}' QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY round(d, 9), dst) <= {K}), al AS (SELECT * FROM ne UNION SELECT snapshot, '{CENTRE}' FROM ne)
SELECT snapshot, src, dst, {r("d", "rho")} FROM ed WHERE src < dst AND (snapshot, src) IN (SELECT (snapshot, node) FROM al) AND (snapshot, dst) IN (SELECT (snapshot, node) FROM al)""",
    "d_neighbourhood_change": PAIRS + """, o AS (SELECT src, dst FROM ed WHERE snapshot = (SELECT min(snapshot) FROM ed)), n AS (SELECT src, dst FROM ed WHERE snapshot = (SELECT max(snapshot) FROM ed))
SELECT src, dst, CASE WHEN o.src IS NOT NULL AND n.src IS NOT NULL THEN 'stable' WHEN n.src IS NULL THEN 'lost' ELSE 'gained' END AS change FROM o FULL JOIN n USING (src, dst)""",
    "d_as_of": PAIRS + f""", sm AS (SELECT a.snapshot, a.src, count(*) AS same FROM ed a JOIN ed b ON b.snapshot = a.snapshot - {STEP} AND a.src = b.src AND a.dst = b.dst GROUP BY 1, 2),
tu AS (SELECT d.snapshot, d.src, d.degree, CASE WHEN w.src IS NOT NULL THEN 1 - coalesce(same, 0) / greatest(d.degree, 1) END AS turnover FROM deg d LEFT JOIN deg w ON w.snapshot = d.snapshot - {STEP} AND w.src = d.src LEFT JOIN sm ON sm.snapshot = d.snapshot AND sm.src = d.src)
SELECT series, dt, last_value(degree IGNORE NULLS) OVER w AS degree, round(last_value(turnover IGNORE NULLS) OVER w, 6) + 0.0 AS turnover FROM wk LEFT JOIN tu ON tu.snapshot = wk.i AND tu.src = wk.series WINDOW w AS (PARTITION BY series ORDER BY dt)""",
    "e_standardised": PANEL + ', xx AS (SELECT * FROM x WHERE "log_RV1" IS NOT NULL AND "log_RV22" IS NOT NULL),' + c._folds("xx", 2) + """, ss AS (SELECT series, fold, avg("log_RV1") AS m1, stddev_pop("log_RV1") AS s1, avg("log_RV22") AS m2, stddev_pop("log_RV22") AS s2 FROM fo WHERE role = 'train' GROUP BY 1, 2)
SELECT series, dt, CAST(fold AS BIGINT) AS fold, role, round(("log_RV1" - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) + 0.0 AS "log_RV1", round(("log_RV22" - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) + 0.0 AS "log_RV22" FROM fo JOIN ss USING (series, fold)""",
    "f_weighted_recall": PANEL + """, xx AS (SELECT * FROM x WHERE "RV5" IS NOT NULL AND "Y_fwd" IS NOT NULL), t AS (SELECT series, quantile_cont("Y_fwd", 0.8) AS th FROM xx GROUP BY 1)
SELECT series, round(coalesce(sum(ln(1 + "Y_fwd")) FILTER (round(5 * "RV5", 6) > round(th, 6)), 0) / sum(ln(1 + "Y_fwd")), 6) + 0.0 AS "Weighted_Recall" FROM xx JOIN t USING (series) WHERE "Y_fwd" > th GROUP BY 1""",
    "g_per_ticker": METRICS + """, w AS (SELECT "Category", "Model" FROM (SELECT "Category", "Model", avg("RMSE_log") AS v FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round(v, 9), "Model") = 1)
SELECT "Category", "Ticker", "Model", round("RMSE_log", 6) + 0.0 AS value FROM b JOIN w USING ("Category", "Model")""",
    "g_summary_without_outliers": f'{METRICS}, gd AS (SELECT "Ticker" FROM m GROUP BY 1 HAVING avg("R2") >= 0.18), bb AS ({MEANS} WHERE "Ticker" IN (SELECT "Ticker" FROM gd) GROUP BY 1, 2, 3) {SUMMARY} FROM bb GROUP BY 1, 2',
    "g_ticker_winners": f'{METRICS}{NET} SELECT "Ticker", {r("network", "baseline", "delta")}, CASE WHEN round(delta, 9) < 0 THEN \'network\' ELSE \'baseline\' END AS winner FROM pd',
    "g_extremes": METRICS + NET + """, z AS (SELECT 'network' AS favours, row_number() OVER (ORDER BY round(delta, 9), "Ticker") AS place, "Ticker", delta FROM pd UNION ALL SELECT 'baseline', row_number() OVER (ORDER BY round(delta, 9) DESC, "Ticker"), "Ticker", delta FROM pd)
SELECT favours, place, "Ticker", round(delta, 6) + 0.0 AS delta FROM z WHERE place <= 5""",
    "g_chosen_on_validation": f'{CHOSEN} SELECT "Category", "Model", round(value, 6) + 0.0 AS value FROM ch',
    "g_test_report": f'{CHOSEN}, bb AS ({MEANS} WHERE "Fold" = 0 AND ("Category", "Model") IN (SELECT ("Category", "Model") FROM ch) GROUP BY 1, 2, 3) {SUMMARY} FROM bb GROUP BY 1, 2',
    "g_baseline_and_network": METRICS + """, v AS (SELECT "Category", "Model", avg("RMSE_log") AS value, "Category" LIKE '%[k=%' AS is_network FROM m GROUP BY 1, 2)
SELECT "Category", "Model", round(value, 6) + 0.0 AS value, is_network FROM v QUALIFY row_number() OVER (PARTITION BY is_network ORDER BY round(value, 9), "Category", "Model") = 1""",
    "h_histogram": PANEL + """, e AS (SELECT quantile_cont("Returns", 0.01) AS lo, quantile_cont("Returns", 0.99) AS hi FROM ret),
g AS (SELECT least(floor(("Returns" - lo) / ((hi - lo) / 20)) + 1, 20) AS bin, (hi - lo) / 20 AS width FROM ret, e WHERE "Returns" BETWEEN lo AND hi)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * any_value(width)), 5) + 0.0 AS density FROM g GROUP BY 1""",
}
