"""All queries over the reference capabilities, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltide.functions import features as fx
from voltide.operators import eda, models, network, reports
from voltide.sources import panels
from voltide.sources.store import written

TEST, TRAIN, STEP, WINDOW, K = 252, 1260, 5, 60, 5


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (with no negative zero) and counts as BIGINT, so engines agree."""
    out = []
    for c, kind in df.dtypes:
        v = F.col(f"`{c}`")
        out.append(((F.round(v, digits) + F.lit(0.0)) if kind == "double" else v.cast("bigint") if kind in ("int", "bigint") else v).alias(c))
    return df.select(*out)


def panel(spark, d, unit="day", sold=None):
    """Returns of the dense panel. A query that reads the sales for more than this has them totalled once,
    by `panels.totals`, and passes them on as `sold`."""
    return fx.returns(panels.prices(spark, d, unit, sold))


def featured(spark, d, unit="day", sold=None):
    return fx.variance_features(panel(spark, d, unit, sold))


def with_market(spark, d):
    """The variance features with those of the market."""
    sold = panels.totals(spark, d)
    return fx.market_features(featured(spark, d, sold=sold), panels.market(spark, d, sold=sold))


def pairs(spark, d, sold=None):
    return network.squared_distance(network.correlations(panel(spark, d, sold=sold), WINDOW, STEP))


def graph(spark, d, k=K, sold=None):
    """The pairs and the edges of each series' `k` nearest, both written: several steps read them."""
    p = written(pairs(spark, d, sold))
    return p, written(network.knn_edges(p, k))


def b_returns(spark, d):
    return rounded(fx.returns(panels.prices(spark, d), (2, 5)).drop("i", "px"))


def b_variance_features(spark, d):
    return rounded(featured(spark, d).drop("i", "px"))


def b_market_features(spark, d):
    sold = panels.totals(spark, d)
    return rounded(fx.market_features(panel(spark, d, sold=sold), panels.market(spark, d, sold=sold)).select("series", "dt", "Market_Returns", "Market_RV5", "Market_RV22", "log_Market_RV5", "log_Market_RV22"))


def b_remove_outliers(spark, d):
    return rounded(fx.remove_outliers(featured(spark, d), ["log_RV1", "log_RV5"], ["series"]).select("series", "dt", "log_RV1", "log_RV5"))


def b_spike_labels(spark, d):
    return rounded(fx.spike_labels(featured(spark, d)).where("Y_fwd is not null").select("series", "dt", "threshold", "spike"))


def c_correlation_pairs(spark, d):
    return rounded(pairs(spark, d))


def c_knn_graph(spark, d):
    return rounded(network.knn_edges(pairs(spark, d), K))


def c_threshold_graph(spark, d):
    return rounded(network.threshold_edges(pairs(spark, d), 0.9))


def c_mean_abs_correlation(spark, d):
    return rounded(pairs(spark, d).groupBy("snapshot").agg(F.avg(F.abs("rho")).alias("avg_abs_corr"), F.count(F.lit(1)).alias("n_pairs")))


def d_turnover(spark, d):
    p, e = graph(spark, d)
    return rounded(network.turnover(e, network.nodes(p), STEP))


def d_clustering(spark, d):
    p, e = graph(spark, d)
    return rounded(network.clustering(e, network.nodes(p)))


def d_neighbour_means(spark, d):
    sold = panels.totals(spark, d)
    return rounded(network.neighbour_means(network.knn_edges(pairs(spark, d, sold), K), featured(spark, d, sold=sold), "log_RV5"), 5)


def d_neighbour_means_exp(spark, d):
    sold = panels.totals(spark, d)
    return rounded(network.neighbour_means(network.knn_edges(pairs(spark, d, sold), K), featured(spark, d, sold=sold), "log_RV5", kernel="exp"), 5)


def e_folds(spark, d):
    return rounded(fx.folds(panel(spark, d), 2, TEST, TRAIN).groupBy("series", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last")))


def forecasts(spark, d, unit="day", test_rows=TEST, train_rows=TRAIN):
    """Test-block forecasts of the naive models and of three linear ones."""
    rows = fx.folds(featured(spark, d, unit).dropna(subset=["log_RV1", "log_RV5", "log_RV22", "log_Y"]), 2, test_rows, train_rows)
    keys, columns = ["series", "fold"], ["log_RV1", "log_RV5", "log_RV22"]
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    g = models.gram(train, keys, columns, "log_Y")
    own = ["series", "dt", "fold", F.col("Y_fwd").alias("y_true")]
    out = test.select(*own, F.lit("Naive").alias("category"), F.lit("week").alias("model"), models.naive_week().alias("y_pred"))
    out = out.unionByName(test.select(*own, F.lit("Naive").alias("category"), F.lit("month").alias("model"), models.naive_month().alias("y_pred")))
    for name, args in (("OLS", {}), ("Ridge", {"ridge": 1.0}), ("Lasso", {"lasso": 0.05})):
        p = models.predict_linear(test, models.fit_linear(g, keys, **args), keys, columns)
        out = out.unionByName(p.select(*own, F.lit("HAR").alias("category"), F.lit(name).alias("model"), "y_pred"))
    return out


def flagship(spark: SparkSession, d: str, unit="day", test_rows=TEST, train_rows=TRAIN) -> DataFrame:
    """Which forecast of the next days' variance is best over all series?"""
    m = reports.regression_metrics(forecasts(spark, d, unit, test_rows, train_rows), ["category", "model", "series", "fold"])
    return m.groupBy("category", "model").agg(F.avg("RMSE_log").alias("RMSE_log"), F.avg("R2_log").alias("R2_log"), F.count_distinct("series").alias("n_series")).orderBy("RMSE_log")


def m_forecast_leaderboard(spark, d):
    return rounded(flagship(spark, d))


def m_har_coefficients(spark, d):
    rows = fx.folds(featured(spark, d).dropna(subset=["log_RV1", "log_RV5", "log_RV22", "log_Y"]), 1, TEST, TRAIN).where("role = 'train'")
    got = models.fit_linear(models.gram(rows, ["series"], ["log_RV5"], "log_Y"), ["series"])
    return rounded(got.select("series", F.element_at("coef", 1).alias("slope"), "intercept"))


def m_ewma(spark, d):
    return rounded(models.ewma_variance(panel(spark, d)).select("series", "dt", "ewma"), 3)


def f_regression_metrics(spark, d):
    rows = fx.folds(featured(spark, d).dropna(subset=["RV22", "Y_fwd"]), 1, TEST, TRAIN).where("role = 'test'")
    preds = rows.select("series", F.col("Y_fwd").alias("y_true"), models.naive_week().alias("y_pred"))
    return rounded(reports.regression_metrics(preds, ["series"]))


def f_classification_metrics(spark, d):
    rows = fx.spike_labels(featured(spark, d).dropna(subset=["RV5", "Y_fwd"]))
    proba = F.round("RV5", 1)
    return rounded(reports.classification_metrics(rows.select("series", F.col("spike").alias("label"), (F.round(5 * F.col("RV5"), 6) > F.round("threshold", 6)).cast("int").alias("pred"), proba.alias("proba")), ["series"]))


def g_summary(spark, d):
    return rounded(reports.summarize(reports.clip_extremes(panels.metrics(spark, d))))


def g_best_per_category(spark, d):
    return rounded(reports.best(reports.summarize(panels.metrics(spark, d)), ["Category"], "mean_RMSE_log").select("Category", "Model", "mean_RMSE_log"))


def g_coalesced(spark, d):
    return rounded(reports.coalesce_categories(panels.metrics(spark, d)).groupBy("Base", "Category").agg(F.count(F.lit(1)).alias("n"), F.avg("R2").alias("R2")))


def g_k_breakdown(spark, d):
    return rounded(reports.k_breakdown(panels.metrics(spark, d)))


def g_ablation_distance(spark, d):
    return rounded(reports.ablation(panels.metrics(spark, d), ["distance", "k"]))


def g_paired_differences(spark, d):
    return rounded(reports.paired_differences(panels.metrics(spark, d)))


def g_signed_rank(spark, d):
    return rounded(reports.signed_rank(reports.paired_differences(panels.metrics(spark, d))).drop("most_ties"))


def h_autocorrelation(spark, d):
    return rounded(eda.autocorrelation(panel(spark, d)))


def h_distribution(spark, d):
    return rounded(eda.distribution(panel(spark, d)))


def h_tail_outliers(spark, d):
    return rounded(eda.tail_outliers(panel(spark, d)))


def h_normalised(spark, d):
    return rounded(eda.normalised(panels.prices(spark, d)))


QUERIES = {f.__name__: f for f in (
    b_returns, b_variance_features, b_market_features, b_remove_outliers, b_spike_labels, c_correlation_pairs, c_knn_graph, c_threshold_graph,
    c_mean_abs_correlation, d_turnover, d_clustering, d_neighbour_means, d_neighbour_means_exp, e_folds, m_forecast_leaderboard, m_har_coefficients, m_ewma,
    f_regression_metrics, f_classification_metrics, g_summary, g_best_per_category, g_coalesced, g_k_breakdown, g_ablation_distance, g_paired_differences,
    g_signed_rank, h_autocorrelation, h_distribution, h_tail_outliers, h_normalised,
)}

SALES = """items AS (SELECT p_brand AS series, CAST(l_shipdate AS DATE) AS dt, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey),
seen AS (SELECT series, dt, sum(price) / sum(qty) AS px FROM items GROUP BY 1, 2)"""
PANEL = f"""WITH {SALES},
cal AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM seen)),
grid AS (SELECT s.series, c.dt, c.i FROM (SELECT DISTINCT series FROM seen) s, cal c),
wk AS (SELECT series, dt, i, last_value(px IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt) AS px FROM grid LEFT JOIN seen USING (series, dt)),
ret AS (SELECT *, 100 * ln(px / lag(px) OVER w) AS "Returns", 100 * ln(px / lag(px, 2) OVER w) AS "Returns_Lag_2", 100 * ln(px / lag(px, 5) OVER w) AS "Returns_Lag_5" FROM wk WINDOW w AS (PARTITION BY series ORDER BY dt)),
sq AS (SELECT *, "Returns" * "Returns" AS "RV1" FROM ret),
v AS (SELECT *,
 CASE WHEN count("RV1") OVER w5 = 5 THEN avg("RV1") OVER w5 END AS "RV5", CASE WHEN count("RV1") OVER w10 = 10 THEN avg("RV1") OVER w10 END AS "RV10", CASE WHEN count("RV1") OVER w22 = 22 THEN avg("RV1") OVER w22 END AS "RV22",
 CASE WHEN count(*) OVER w5 = 5 THEN avg(CASE WHEN "Returns" < 0 THEN "RV1" ELSE 0 END) OVER w5 END AS neg_semi_var5, CASE WHEN count(*) OVER w5 = 5 THEN avg(CASE WHEN "Returns" > 0 THEN "RV1" ELSE 0 END) OVER w5 END AS pos_semi_var5,
 CASE WHEN count("RV1") OVER f5 = 5 THEN sum("RV1") OVER f5 END AS "Y_fwd" FROM sq
 WINDOW w5 AS (PARTITION BY series ORDER BY dt ROWS 4 PRECEDING), w10 AS (PARTITION BY series ORDER BY dt ROWS 9 PRECEDING), w22 AS (PARTITION BY series ORDER BY dt ROWS 21 PRECEDING), f5 AS (PARTITION BY series ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
x AS (SELECT *, ln("RV1" + 1e-8) AS "log_RV1", ln("RV5" + 1e-8) AS "log_RV5", ln("RV10" + 1e-8) AS "log_RV10", ln("RV22" + 1e-8) AS "log_RV22", ln(neg_semi_var5 + 1e-8) AS log_neg_semi5, ln(pos_semi_var5 + 1e-8) AS log_pos_semi5, ln("Y_fwd" + 1e-8) AS "log_Y" FROM v)"""
PAIRS = PANEL + f""",
snaps AS (SELECT i AS snapshot FROM cal WHERE i >= {WINDOW} AND (i - {WINDOW}) % {STEP} = 0),
h0 AS (SELECT snapshot, series, i, "Returns" AS r FROM snaps JOIN ret ON i > snapshot - {WINDOW} AND i <= snapshot),
h1 AS (SELECT * FROM h0 WHERE (snapshot, series) IN (SELECT (snapshot, series) FROM h0 GROUP BY snapshot, series HAVING count(r) >= 0.8 * {WINDOW})),
h2 AS (SELECT snapshot, series, i, coalesce(r, 0) AS r FROM h1 WHERE snapshot IN (SELECT snapshot FROM h1 GROUP BY 1 HAVING count(DISTINCT series) >= 10)),
mo AS (SELECT a.snapshot, a.series AS s1, b.series AS s2, covar_pop(a.r, b.r) AS c, var_pop(a.r) AS va, var_pop(b.r) AS vb FROM h2 a JOIN h2 b ON a.snapshot = b.snapshot AND a.i = b.i AND a.series < b.series GROUP BY 1, 2, 3),
rh AS (SELECT snapshot, s1, s2, CASE WHEN va > 1e-12 AND vb > 1e-12 THEN least(greatest(c / sqrt(va * vb), -1 + 1e-8), 1 - 1e-8) END AS r0 FROM mo),
pr AS (SELECT snapshot, s1, s2, CASE WHEN bool_or(r0 IS NULL) OVER (PARTITION BY snapshot) THEN 0.0 ELSE r0 END AS rho FROM rh),
p AS (SELECT *, 1 - rho * rho AS d FROM pr),
bw AS (SELECT snapshot, s1 AS src, s2 AS dst, d, rho FROM p UNION ALL SELECT snapshot, s2, s1, d, rho FROM p),
nn AS (SELECT * FROM bw QUALIFY row_number() OVER (PARTITION BY snapshot, src ORDER BY round(d, 9), dst) <= {K}),
ed AS (SELECT DISTINCT snapshot, src, dst, d, rho FROM (SELECT * FROM nn UNION ALL SELECT snapshot, dst, src, d, rho FROM nn)),
nodes AS (SELECT DISTINCT snapshot, src FROM bw),
deg AS (SELECT snapshot, src, count(dst) AS degree FROM nodes LEFT JOIN ed USING (snapshot, src) GROUP BY 1, 2)"""
METRICS = """WITH m AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'HAR' WHEN 1 THEN 'Network' || k WHEN 2 THEN 'PCorr Network' || k ELSE 'MI Network' || k END AS "Category", p_brand AS "Ticker", 'M-' || l_returnflag || l_linestatus AS "Model", month(l_shipdate) % 2 AS "Fold",
 stddev_pop(ln(CAST(l_extendedprice AS DOUBLE))) AS "RMSE_log", avg(CAST(l_discount AS DOUBLE)) * 12 - 0.3 AS "R2_log", stddev_pop(CAST(l_quantity AS DOUBLE)) AS "RMSE", avg(CAST(l_tax AS DOUBLE)) * 12 - 0.3 AS "R2", avg(CAST(l_quantity AS DOUBLE)) AS "MAE"
 FROM (SELECT *, ' [k=' || (l_suppkey % 5 + 1) || ']' AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2, 3, 4),
b AS (SELECT "Category", "Ticker", "Model", avg("RMSE_log") AS "RMSE_log", avg("R2_log") AS "R2_log", avg("R2") AS "R2" FROM m GROUP BY 1, 2, 3),
s AS (SELECT "Category", "Model", avg("RMSE_log") AS mean_RMSE_log, median("RMSE_log") AS median_RMSE_log, avg("R2_log") AS mean_R2_log, avg(CASE WHEN "R2_log" > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, count(DISTINCT "Ticker") AS n_tickers, avg("R2") AS r2 FROM b GROUP BY 1, 2 HAVING avg("R2") >= -100),
e AS (SELECT *, trim(regexp_replace("Category", '\\s*\\[k=\\d+\\]', '')) AS "Base", CAST(nullif(regexp_extract("Category", '\\[k=(\\d+)\\]', 1), '') AS INTEGER) AS k FROM m)"""
NET = """, mm AS (SELECT "Category", "Model", avg("RMSE_log") AS mm, "Category" LIKE '%[k=%' AS net FROM b GROUP BY 1, 2),
win AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY net ORDER BY round(mm, 9), "Category", "Model") = 1),
own AS (SELECT b.*, net FROM b JOIN win USING ("Category", "Model")),
pd AS (SELECT x."Ticker", x."RMSE_log" AS network, y."RMSE_log" AS baseline, x."RMSE_log" - y."RMSE_log" AS delta FROM own x JOIN own y ON x."Ticker" = y."Ticker" AND x.net AND NOT y.net)"""


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f'round("{n}", {digits}) + 0.0 AS "{n}"' for n in names)


def _folds(source: str, n: int) -> str:
    return f"""fr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt) AS pos, count(*) OVER (PARTITION BY series) AS cnt FROM {source}),
fo AS (SELECT fr.*, fold, CASE WHEN pos > cnt - fold * {TEST} - {TEST} THEN 'test' ELSE 'train' END AS role FROM fr, range({n}) t(fold) WHERE cnt >= {TRAIN + TEST} AND cnt - fold * {TEST} - {TEST} >= {TRAIN} AND pos <= cnt - fold * {TEST})"""


ORACLES = {
    "b_returns": f'{PANEL} SELECT series, dt, {r("Returns", "Returns_Lag_2", "Returns_Lag_5")} FROM ret',
    "b_variance_features": f'{PANEL} SELECT series, dt, {r("Returns", "RV1", "RV5", "RV10", "RV22", "neg_semi_var5", "pos_semi_var5", "Y_fwd", "log_RV1", "log_RV5", "log_RV10", "log_RV22", "log_neg_semi5", "log_pos_semi5", "log_Y")} FROM x',
    "b_market_features": PANEL + f""", mk0 AS (SELECT dt, sum(price) / sum(qty) AS px FROM items GROUP BY 1), mk AS (SELECT dt, 100 * ln(px / lag(px) OVER (ORDER BY dt)) AS "Market_Returns" FROM mk0),
j AS (SELECT series, dt, "Market_Returns", "Market_Returns" ** 2 AS m2 FROM wk LEFT JOIN mk USING (dt)),
k AS (SELECT *, CASE WHEN count(m2) OVER w5 = 5 THEN avg(m2) OVER w5 END AS "Market_RV5", CASE WHEN count(m2) OVER w22 = 22 THEN avg(m2) OVER w22 END AS "Market_RV22" FROM j WINDOW w5 AS (PARTITION BY series ORDER BY dt ROWS 4 PRECEDING), w22 AS (PARTITION BY series ORDER BY dt ROWS 21 PRECEDING)),
l AS (SELECT *, ln("Market_RV5" + 1e-8) AS "log_Market_RV5", ln("Market_RV22" + 1e-8) AS "log_Market_RV22" FROM k)
SELECT series, dt, {r("Market_Returns", "Market_RV5", "Market_RV22", "log_Market_RV5", "log_Market_RV22")} FROM l""",
    "b_remove_outliers": PANEL + f""", z AS (SELECT *, avg("log_RV1") OVER w AS m1, stddev_samp("log_RV1") OVER w AS s1, avg("log_RV5") OVER w AS m5, stddev_samp("log_RV5") OVER w AS s5 FROM x WINDOW w AS (PARTITION BY series))
SELECT series, dt, {r("log_RV1", "log_RV5")} FROM z WHERE (s1 = 0 OR abs(("log_RV1" - m1) / nullif(s1, 0)) < 3) AND (s5 = 0 OR abs(("log_RV5" - m5) / nullif(s5, 0)) < 3)""",
    "b_spike_labels": PANEL + """, t AS (SELECT series, quantile_cont("Y_fwd", 0.8) AS th FROM x WHERE "Y_fwd" IS NOT NULL GROUP BY 1)
SELECT series, dt, round(th, 6) + 0.0 AS threshold, CAST("Y_fwd" > th AS BIGINT) AS spike FROM x JOIN t USING (series) WHERE "Y_fwd" IS NOT NULL""",
    "c_correlation_pairs": f'{PAIRS} SELECT snapshot, s1, s2, {r("rho", "d")} FROM p',
    "c_knn_graph": f'{PAIRS} SELECT snapshot, src, dst, {r("d", "rho")} FROM ed',
    "c_threshold_graph": f'{PAIRS} SELECT snapshot, src, dst, {r("d", "rho")} FROM bw WHERE d < 0.9',
    "c_mean_abs_correlation": f"{PAIRS} SELECT snapshot, round(avg(abs(rho)), 6) + 0.0 AS avg_abs_corr, count(*) AS n_pairs FROM p GROUP BY 1",
    "d_turnover": PAIRS + f""", sm AS (SELECT a.snapshot, a.src, count(*) AS same FROM ed a JOIN ed b ON b.snapshot = a.snapshot - {STEP} AND a.src = b.src AND a.dst = b.dst GROUP BY 1, 2)
SELECT d.snapshot, d.src, d.degree, CASE WHEN w.src IS NOT NULL THEN round(1 - coalesce(same, 0) / greatest(d.degree, 1), 6) + 0.0 END AS turnover FROM deg d LEFT JOIN deg w ON w.snapshot = d.snapshot - {STEP} AND w.src = d.src LEFT JOIN sm ON sm.snapshot = d.snapshot AND sm.src = d.src""",
    "d_clustering": PAIRS + """, tr AS (SELECT a.snapshot, a.src, count(*) AS t FROM ed a JOIN ed b ON a.snapshot = b.snapshot AND a.src = b.src AND a.dst < b.dst JOIN ed c ON c.snapshot = a.snapshot AND c.src = a.dst AND c.dst = b.dst GROUP BY 1, 2)
SELECT snapshot, src, CASE WHEN degree < 2 THEN 0.0 ELSE round(2 * coalesce(t, 0) / (degree * (degree - 1)), 6) + 0.0 END AS clustering FROM deg LEFT JOIN tr USING (snapshot, src)""",
    "e_folds": PANEL + "," + _folds("ret", 2) + "SELECT series, fold, role, count(*) AS n, min(dt) AS first, max(dt) AS last FROM fo GROUP BY 1, 2, 3",
    "m_har_coefficients": PANEL + ', xx AS (SELECT * FROM x WHERE "log_RV1" IS NOT NULL AND "log_RV5" IS NOT NULL AND "log_RV22" IS NOT NULL AND "log_Y" IS NOT NULL),' + _folds("xx", 1) + """SELECT series, round(regr_slope("log_Y", "log_RV5"), 6) + 0.0 AS slope, round(regr_intercept("log_Y", "log_RV5"), 6) + 0.0 AS intercept FROM fo WHERE role = 'train' GROUP BY 1""",
    "m_ewma": PANEL.replace("WITH ", "WITH RECURSIVE ", 1) + """, q AS (SELECT series, dt, "RV1" AS r2, row_number() OVER (PARTITION BY series ORDER BY dt) AS j FROM x WHERE "Returns" IS NOT NULL),
rc AS (SELECT series, 1 AS j, (SELECT avg(r2) FROM q b WHERE b.series = a.series AND b.j <= 50) AS e FROM (SELECT DISTINCT series FROM q) a UNION ALL SELECT rc.series, rc.j + 1, 0.94 * e + 0.06 * q.r2 FROM rc JOIN q ON q.series = rc.series AND q.j = rc.j WHERE rc.j < (SELECT max(j) FROM q))
SELECT series, dt, round(e, 3) + 0.0 AS ewma FROM rc JOIN q USING (series, j)""",
    "f_regression_metrics": PANEL + ', xx AS (SELECT * FROM x WHERE "RV22" IS NOT NULL AND "Y_fwd" IS NOT NULL),' + _folds("xx", 1) + """, pp AS (SELECT series, "Y_fwd" AS y, 5 * "RV5" AS p, ln(greatest("Y_fwd", 1e-8)) AS ly, ln(greatest(5 * "RV5", 1e-8)) AS lp FROM fo WHERE role = 'test')
SELECT series, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) + 0.0 AS "R2", round(sqrt(avg((y - p) ** 2)), 6) + 0.0 AS "RMSE", round(avg(abs(y - p)), 6) + 0.0 AS "MAE", round(1 - sum((ly - lp) ** 2) / (var_pop(ly) * count(*)), 6) + 0.0 AS "R2_log", round(sqrt(avg((ly - lp) ** 2)), 6) + 0.0 AS "RMSE_log", round(avg(abs(ly - lp)), 6) + 0.0 AS "MAE_log" FROM pp GROUP BY 1""",
    "g_summary": f'{METRICS} SELECT "Category", "Model", {r("mean_RMSE_log", "median_RMSE_log", "mean_R2_log", "share_positive")}, n_tickers FROM s',
    "g_best_per_category": f'{METRICS} SELECT "Category", "Model", round(mean_RMSE_log, 6) + 0.0 AS "mean_RMSE_log" FROM s QUALIFY row_number() OVER (PARTITION BY "Category" ORDER BY round(mean_RMSE_log, 9), "Model") = 1',
    "g_coalesced": METRICS + """, w AS (SELECT "Base", "Category" FROM (SELECT "Base", "Category", "Model", avg("R2") AS v FROM e GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY "Base" ORDER BY round(v, 9) DESC NULLS LAST, "Category", "Model") = 1)
SELECT "Base", "Category", count(*) AS n, round(avg("R2"), 6) + 0.0 AS "R2" FROM e WHERE "Category" IN (SELECT "Category" FROM w) GROUP BY 1, 2""",
    "g_k_breakdown": METRICS + """, w AS (SELECT "Base", coalesce(k, 0) AS k, v FROM (SELECT "Base", k, "Category", "Model", avg("RMSE_log") AS v FROM e GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY "Base", k ORDER BY round(v, 9), "Category", "Model") = 1)
SELECT "Base", """ + ", ".join(f"round(max(CASE WHEN k = {i} THEN v END), 6) + 0.0 AS k{i}" for i in range(6)) + ' FROM w GROUP BY 1',
    "g_ablation_distance": METRICS + """, a AS (SELECT CASE WHEN "Base" LIKE 'PCorr%' THEN 'PCorr' WHEN "Base" LIKE 'MI%' THEN 'MI' ELSE 'SqCorr' END AS distance, k, "Category", "Model", avg("RMSE_log") AS value FROM e WHERE k IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT distance, CAST(k AS BIGINT) AS k, "Category", "Model", round(value, 6) + 0.0 AS value FROM a QUALIFY row_number() OVER (PARTITION BY distance, k ORDER BY round(value, 9), "Category", "Model") = 1""",
    "g_paired_differences": f'{METRICS}{NET} SELECT "Ticker", {r("network", "baseline", "delta")} FROM pd',
    "g_signed_rank": METRICS + NET + """, k AS (SELECT delta, rank() OVER (ORDER BY round(abs(delta), 12)) + (count(*) OVER (PARTITION BY round(abs(delta), 12)) - 1) / 2 AS rk FROM pd WHERE delta <> 0),
t AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (delta > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (delta < 0), 0) AS w_minus, count(*) FILTER (delta < 0) AS network_wins, count(*) FILTER (delta > 0) AS baseline_wins FROM k)
SELECT n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, network_wins, baseline_wins, (SELECT round(avg(delta), 6) + 0.0 FROM pd) AS mean_delta, (SELECT round(median(delta), 6) + 0.0 FROM pd) AS median_delta, round((least(w_plus, w_minus) - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24), 0), 6) + 0.0 AS z FROM t""",
    "h_autocorrelation": PANEL + """, a AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY dt) AS j, "Returns" - avg("Returns") OVER (PARTITION BY series) AS c FROM ret WHERE "Returns" IS NOT NULL),
t AS (SELECT series, sum(c * c) AS ss, count(*) AS n FROM a GROUP BY 1), l AS (SELECT a.series, a.j - b.j AS lag, sum(a.c * b.c) AS s FROM a JOIN a b ON a.series = b.series AND a.j - b.j BETWEEN 1 AND 10 GROUP BY 1, 2)
SELECT series, lag, round(s / ss, 6) + 0.0 AS acf, round(1.96 / sqrt(n), 6) + 0.0 AS band FROM l JOIN t USING (series)""",
    "h_distribution": f'{PANEL} SELECT series, count(*) AS n, round(avg("Returns"), 6) + 0.0 AS mean, round(stddev_samp("Returns"), 6) + 0.0 AS std, round(skewness("Returns"), 6) + 0.0 AS skew, round(kurtosis("Returns"), 6) + 0.0 AS kurtosis FROM ret WHERE "Returns" IS NOT NULL GROUP BY 1',
    "h_tail_outliers": PANEL + """, c AS (SELECT series, quantile_cont("Returns", 0.01) AS lo, quantile_cont("Returns", 0.99) AS hi FROM ret GROUP BY 1)
SELECT series, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high, count(*) FILTER ("Returns" <= lo) AS n_low, count(*) FILTER ("Returns" >= hi) AS n_high, count("Returns") AS n FROM ret JOIN c USING (series) WHERE "Returns" IS NOT NULL GROUP BY series, lo, hi""",
    "h_normalised": f'{PANEL} SELECT series, dt, round(100 * px / first_value(px IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) + 0.0 AS index FROM wk',
}


def _neighbours(weight: str) -> str:
    m = lambda f: f'round(sum(w * v) {f} / sum(w) {f}, 5) + 0.0'
    return PAIRS + f""", nv AS (SELECT ed.*, "log_RV5" AS v, {weight} AS w FROM ed JOIN x ON x.i = ed.snapshot AND x.series = ed.dst WHERE "log_RV5" IS NOT NULL)
SELECT snapshot, src, {m("")} AS idw, {m("FILTER (rho > 0)")} AS idw_pos, {m("FILTER (NOT rho > 0)")} AS idw_neg FROM nv GROUP BY 1, 2"""


ORACLES["d_neighbour_means"] = _neighbours("1 / greatest(d, 1e-8)")
ORACLES["d_neighbour_means_exp"] = _neighbours("exp(-5 * d)")
ORACLES["f_classification_metrics"] = PANEL + """, xx AS (SELECT * FROM x WHERE "RV5" IS NOT NULL AND "Y_fwd" IS NOT NULL), t AS (SELECT series, quantile_cont("Y_fwd", 0.8) AS th FROM xx GROUP BY 1),
l AS (SELECT series, "Y_fwd" > th AS y, round(5 * "RV5", 6) > round(th, 6) AS p, round("RV5", 1) AS s FROM xx JOIN t USING (series)),
k AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY s) + (count(*) OVER (PARTITION BY series, s) - 1) / 2 AS rk FROM l),
a AS (SELECT series, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, sum(rk) FILTER (y) AS rs, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc FROM k GROUP BY 1)
SELECT series, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS "F1", round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS "Precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS "Recall", round(acc, 6) + 0.0 AS "Accuracy", CASE WHEN n1 > 0 AND n0 > 0 THEN round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) + 0.0 END AS "ROC_AUC" FROM a"""
