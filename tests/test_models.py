"""Models and tests of significance against direct computations in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from voltide.operators import forecasting as fc
from voltide.operators import models, network, reports, spikes, timeseries
from voltide.operators.models import Gram

KEYS = ["series", "fold"]


def sample(n=300, p=6, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) * r.uniform(0.2, 5, p) + r.normal(size=p) * 3
    return x, x @ r.normal(size=p) / x.std(0).mean() + r.normal(size=n)


def one_gram(x, y):
    z = np.column_stack((x, y))
    c = z - z.mean(0)
    return Gram(len(z), z.mean(0), (c.T @ c)[np.triu_indices(z.shape[1])])


def test_partial_products_merge(spark):
    x, y = sample(500, 4)
    rows = spark.createDataFrame(pd.DataFrame(np.column_stack((x, y)), columns=["a", "b", "c", "d", "y"]).assign(k=np.arange(500) % 3)).repartition(7)
    for got in models.gram(rows, ["k"], ["a", "b", "c", "d"], "y", most_keys=1).collect():
        own = np.column_stack((x, y))[np.arange(500) % 3 == got["k"]]
        c = own - own.mean(0)
        assert got["n"] == len(own) and np.allclose(got["mean"], own.mean(0)) and np.allclose(got["cross"], (c.T @ c)[np.triu_indices(5)])


def test_penalties():
    x, y = sample()
    g, at, n = one_gram(x, y), np.arange(6), len(x)
    s, c = (x - x.mean(0)) / x.std(0), y - y.mean()
    assert np.allclose(g.solve(at), np.linalg.lstsq(x - x.mean(0), c, rcond=None)[0])
    assert np.allclose(g.solve(at, ridge=3.0) * x.std(0), np.linalg.solve(s.T @ s + 3 * np.eye(6), s.T @ c))
    beta = g.solve(at, lasso=0.6) * x.std(0)
    slope = s.T @ (c - s @ beta) / n  # at the optimum: 0.6 times the sign, or within it
    assert np.allclose(slope[beta != 0], 0.6 * np.sign(beta[beta != 0]), atol=1e-6) and (np.abs(slope) <= 0.6 + 1e-6).all() and (beta == 0).any()
    double = one_gram(np.column_stack((x, x[:, 0])), y)  # columns that depend on each other
    assert np.allclose(np.column_stack((x, x[:, 0])) @ double.solve(np.arange(7)), x @ g.solve(at))


def test_lasso_and_ols_agree_with_mllib(spark):
    x, y = sample(200, 3)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(spark.createDataFrame(pd.DataFrame(np.column_stack((x, y)), columns=["a", "b", "c", "y"])))
    g = one_gram(x, y)
    for lasso in (0.0, 0.1):
        fit = LinearRegression(featuresCol="f", labelCol="y", solver="normal", regParam=lasso, elasticNetParam=1.0).fit(rows)
        assert np.allclose(fit.coefficients.toArray(), g.solve(np.arange(3), lasso=lasso), atol=1e-5)


def test_two_stages_and_learned_weights():
    r = np.random.default_rng(1)
    k, n = 3, 400
    names = ["own", *(f"net_nn{i}_{c}" for i in range(k) for c in network.VALUES)]
    x = r.normal(size=(n, len(names)))
    x[:, 1:] += r.normal(size=(n, 1))
    y = x @ r.normal(size=len(names)) + r.normal(size=n)
    g, place = one_gram(x, y), {c: i for i, c in enumerate(names)}
    net = tuple(names[1:4])
    m = fc.Model("c", "two", ("own",), net=net, stage2=2.0, bound=0.3)
    coef, intercept, second, offset = fc._vectors(g, m, place)
    a = np.column_stack((np.ones(n), x[:, 0]))
    left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    z = (x[:, 1:4] - x[:, 1:4].mean(0)) / x[:, 1:4].std(0)
    want = z @ np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ left)
    assert np.allclose(x @ second + offset, want) and np.allclose(y - x @ coef - intercept, left)
    m = fc.Model("c", "learned", ("own",), ridge=0.5, learned=2, k=k)
    coef, intercept, _, _ = fc._vectors(g, m, place)
    tensor = np.stack([x[:, [place[f"net_nn{i}_{c}"] for i in range(k)]] for c in network.VALUES], 1)
    rows = tensor.reshape(-1, k)
    w = np.linalg.svd(rows - rows.mean(0), full_matrices=False)[2][:2]
    d = np.column_stack((x[:, 0], (tensor @ w.T).reshape(n, -1)))
    z = (d - d.mean(0)) / d.std(0)
    want = y.mean() + z @ np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(x @ coef + intercept, want)


def test_catalogue_sizes():
    assert len(fc.baselines()) == 13 and len(timeseries.ARIMA_ORDERS) == 9 and len(timeseries.GARCH_ORDERS) == 7
    assert len(fc.network_models("n")) == len(fc.network_models("n", clustering=True)) == 30
    assert len(fc.network_models("n", split=True)) == len(fc.network_models("n", True, True)) == 26
    assert [len(fc.learned_models("n", k)) for k in (2, 3, 4, 5)] == [10, 20, 30, 40]
    assert len({(m.category, m.name) for m in fc.network_models("n") + fc.learned_models("n", 5)}) == 70


def test_logit(spark):
    x, y = sample(300, 3, 2)
    y = (y > np.quantile(y, 0.7)).astype(int)
    s = (x - x.mean(0)) / x.std(0)
    b = timeseries.fit_logit(s, y, 0.5)
    slope = 0.5 * s.T @ (spikes.sigmoid(s @ b[1:] + b[0]) - y) + b[1:]
    assert np.abs(slope).max() < 1e-6
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(spark.createDataFrame(pd.DataFrame(s, columns=["a", "b", "c"]).assign(y=y.astype(float))))
    fit = LogisticRegression(featuresCol="f", labelCol="y", regParam=1 / (0.5 * 300), standardization=False, tol=1e-10, maxIter=500).fit(rows)
    assert np.allclose(fit.coefficients.toArray(), b[1:], atol=1e-5) and abs(fit.intercept - b[0]) < 1e-5


def simulated(n=3000, omega=0.1, alpha=0.08, beta=0.9, seed=3):
    r = np.random.default_rng(seed)
    h, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        out.append(np.sqrt(h) * r.normal())
        h = omega + alpha * out[-1] ** 2 + beta * h
    return np.array(out)


def test_variance_models():
    r = simulated()
    omega, alpha, beta, start = timeseries.fit_garch(r[:2500], 1, 1)
    assert 0.03 < alpha[0] < 0.15 and 0.8 < beta[0] < 0.97
    params = (0.2, np.array([0.05, 0.03]), np.array([0.5, 0.2, 0.1]), start)
    h = timeseries.variance_filter(r, np.array([0.2]), params[1][None], params[2][None], start)[:, 0]
    want, e = [], np.r_[[start] * 2, r**2]
    past = [start] * 3
    for t in range(len(r) + 1):
        want.append(0.2 + 0.05 * e[t + 1] + 0.03 * e[t] + 0.5 * past[-1] + 0.2 * past[-2] + 0.1 * past[-3])
        past.append(want[-1])
    assert np.allclose(h, want)
    got = timeseries.variance_forecasts(r, params, 2990, 3)
    t = 2995
    one = h[t + 1]
    two = 0.2 + 0.05 * one + 0.03 * r[t] ** 2 + 0.5 * one + 0.2 * h[t] + 0.1 * h[t - 1]
    three = 0.2 + 0.05 * two + 0.03 * one + 0.5 * two + 0.2 * one + 0.1 * h[t]
    assert np.allclose(got[t - 2990], [one, two, three])
    truth = np.array([(r[t + 1 : t + 6] ** 2).sum() for t in range(2500, 2990)])
    fitted = timeseries.variance_forecasts(r, timeseries.fit_garch(r[:2500], 1, 1), 2500, 5).sum(1)[:490]
    assert np.mean(np.abs(np.log(fitted) - np.log(truth))) < np.mean(np.abs(np.log([5 * (r[t - 4 : t + 1] ** 2).mean() for t in range(2500, 2990)]) - np.log(truth)))


def test_correlation_with_the_market_is_found():
    r = np.random.default_rng(5)
    m = simulated(1500, seed=6)
    z = r.normal(size=1500)
    own = 0.8 * m + 0.6 * np.std(m) * z
    c = timeseries.Correlated(own, m, 1200)
    q = c.states()
    rho = q[:, 1] / np.sqrt(q[:, 0] * q[:, 2])
    assert 0.6 < rho[200:].mean() < 0.95 and (np.abs(rho) < 1).all() and (c.scores(1200, 5) > 0).all()


def test_autoregression():
    r = np.random.default_rng(4)
    y = [0.0]
    for _ in range(2000):
        y.append(0.7 * y[-1] + r.normal())
    y = np.array(y) + 5
    mean, ar, ma, _ = timeseries.fit_arma(y, 1, 0)
    assert abs(ar[0] - 0.7) < 0.05
    assert np.allclose(timeseries.forecast_arima(y, (1, 0, 0), 4), mean + (y[-1] - mean) * ar[0] ** np.arange(1, 5))
    _, ar, ma, _ = timeseries.fit_arma(np.convolve(r.normal(size=4001), [1, 0.5])[1:4001], 0, 1)
    assert abs(ma[0] - 0.5) < 0.08
    assert np.isfinite(timeseries.forecast_arima(np.arange(50.0), (2, 1, 1), 3)).all()


@pytest.mark.parametrize("n, w, p", [(96, 1059, 3.52955e-06), (21, 36, 0.00428486)])
def test_signed_rank_p_values(n, w, p):
    total, m = n * (n + 1) / 2, n * (n + 1)
    z = (w - m / 4) / np.sqrt(m * (2 * n + 1) / 24)
    both, one = reports._p_values(n, w, total - w, 1, z, 50)
    assert abs(both / p - 1) < 1e-4 and abs(one / (p / 2) - 1) < 1e-4


def test_ranks_with_ties(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", -0.5), ("c", 1.0), ("d", 0.0), ("e", -2.0)], "Ticker string, delta double")
    got = reports.with_p_values(reports.signed_rank(rows)).first()
    assert (got["n"], got["w_plus"], got["w_minus"], got["network_wins"], got["baseline_wins"]) == (4, 4.5, 5.5, 2, 2)


def test_precision_distance_and_identity():
    m = np.random.default_rng(7).normal(size=(60, 5))
    rho, d = network.precision_distance()(m)
    inverse = np.linalg.inv(0.9 * np.corrcoef(m.T) + 0.1 * np.eye(5))
    want = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    up = np.triu_indices(5, 1)
    assert np.allclose(rho[up], want[up], atol=1e-6) and np.allclose(d[up], 1 - want[up] ** 2, atol=1e-6)
    m[:, 0] = 1
    assert np.allclose(network.precision_distance()(m)[1][up], 1)


def test_long_series_stay_in_range(spark):
    n, r = 12_000, np.random.default_rng(8).normal(size=12_000)
    rows = spark.createDataFrame(pd.DataFrame({"series": "s", "dt": pd.date_range("1980-01-01", periods=n).date, "Returns": r}))
    got = np.array([x["ewma"] for x in models.ewma_variance(rows).orderBy("dt").select("ewma").collect()])
    want = [np.mean(r[:50] ** 2)]
    for x in r[:-1]:
        want.append(0.94 * want[-1] + 0.06 * x * x)
    assert np.allclose(got, want, rtol=1e-9)


def test_no_feature_knows_the_future(spark):
    r = np.random.default_rng(9)
    frame = pd.DataFrame([(f"s{j:02d}", i, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(v)) for j in range(12) for i, v in enumerate(r.normal(size=100), 1)], columns=["series", "i", "dt", "Returns"])

    def made(f):
        panel = spark.createDataFrame(f).withColumns({c: F.col("Returns") * k for k, c in enumerate(network.VALUES[:3], 1)})
        pairs = network.squared_distance(network.correlations(panel, 60, 5))
        edges = network.knn_edges(pairs, 3)
        return network.graph_features(pairs, edges, panel, 3, 5).where("snapshot <= 80").toPandas().sort_values(["snapshot", "src"]).reset_index(drop=True)

    other = frame.assign(Returns=np.where(frame["i"] > 80, r.normal(size=len(frame)), frame["Returns"]))
    pd.testing.assert_frame_equal(made(frame), made(other))
    got = made(frame)
    assert (got["net_degree"] >= 3).all() and got["net_degree_change"].dropna().between(0, 1).all()
