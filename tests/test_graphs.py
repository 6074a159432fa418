"""The evaluation over all graphs: linear models and logits against direct computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltide.operators import forecasting as fc
from voltide.operators import graphs as gr
from voltide.operators import models, network, reports, spikes, timeseries

NAMES = gr.net_names()
GRAPHS = [("sqcorr", 2), ("mi", 3)]
TEST, TRAIN, N = 100, 400, 700


@pytest.fixture(scope="module")
def made(spark):
    """A panel of two series and the arrays of two graphs, in Spark and as matrices by series."""
    r = np.random.default_rng(1)
    rows, nets, plain = [], [], {}
    for s in ("a", "b"):
        x = r.normal(size=(N, len(gr.OWN)))
        x[:, 1:] += r.normal(size=(N, 1)) / 2
        arrays = r.normal(size=(N // 5 + 1, len(GRAPHS) * len(NAMES)))
        nets += [(s, j * 5, a.tolist()) for j, a in enumerate(arrays)]
        net = arrays[np.arange(1, N + 1) // 5]
        y = x @ np.linspace(0.5, -0.2, x.shape[1]) + 0.4 * net[:, :4].sum(1) + r.normal(size=N)
        rows += [(s, t + 1, pd.Timestamp("2000-01-01") + pd.Timedelta(days=t), *x[t].tolist(), float(y[t]), float(np.exp(y[t]))) for t in range(N)]
        v = {"": x, **{gr.graph_id(*g): np.hstack((x, net[:, i * len(NAMES) : (i + 1) * len(NAMES)])) for i, g in enumerate(GRAPHS)}}
        plain[s] = v, y
    columns = ["series", "i", "dt", *gr.OWN, "log_Y", "Y_fwd"]
    panel = spark.createDataFrame(pd.DataFrame(rows, columns=columns).astype({"i": "int32"})).withColumn("dt", F.col("dt").cast("date"))
    return panel, spark.createDataFrame(nets, "series string, snapshot int, net array<double>"), plain


def usual(x, y):
    z = np.column_stack((x[:, [gr.OWN.index(c) for c in fc.OUTLIER_COLUMNS[:3]]], y))
    return (np.abs(z - z.mean(0)) < 3 * z.std(0, ddof=1)).all(1)


def take(graph, v, names):
    place = {c: i for i, c in enumerate([*gr.OWN, *NAMES] if graph else gr.OWN)}
    return v[:, [place[c] for c in names]]


def design(graph, m, v, weights):
    if not m.learned:
        return take(graph, v, m.own)
    ranks = np.stack([take(graph, v, [f"net_nn{r}_{c}" for r in range(m.k)]) for c in network.VALUES], 1)
    if weights is None:
        rows = ranks.reshape(-1, m.k)
        weights = np.linalg.svd(rows - rows.mean(0), full_matrices=False)[2][: m.learned]
    return np.hstack((take(graph, v, m.own), (ranks @ weights.T).reshape(len(v), -1))), weights


def plain_linear(graph, m, v, y, t):
    """Log forecasts of one model: rows before `t` train, the rest is forecast."""
    keep = usual(v[:t], y[:t]) if m.clean else np.ones(t, bool)

    def solved(rows):
        x, weights = design(graph, m, v[:t], None) if m.learned else (take(graph, v[:t], m.own if m.net else m.columns), None)
        if m.learned:
            x, weights = design(graph, m, v[:t][rows], None)
            z = design(graph, m, v, weights)[0]
        else:
            x, z = x[rows], take(graph, v, m.own if m.net else m.columns)
        mean, sd, own = x.mean(0), x.std(0), y[:t][rows]
        s, c = (x - mean) / sd, own - own.mean()
        if m.lasso:
            beta, g, h = np.zeros(s.shape[1]), s.T @ s, s.T @ c
            for _ in range(4000):
                for j in range(len(beta)):
                    q = h[j] - g[j] @ beta + g[j, j] * beta[j]
                    beta[j] = np.sign(q) * max(abs(q) - len(s) * m.lasso, 0) / g[j, j]
        else:
            beta = np.linalg.solve(s.T @ s + m.ridge * np.eye(s.shape[1]), s.T @ c)
        out = own.mean() + ((z - mean) / sd) @ beta
        if m.net:
            e = own - out[:t][rows]
            n = take(graph, v, m.net)
            mean, sd = n[:t][rows].mean(0), n[:t][rows].std(0)
            u = (n - mean) / sd
            w = np.linalg.solve(u[:t][rows].T @ u[:t][rows] + m.stage2 * np.eye(u.shape[1]), u[:t][rows].T @ e)
            out = out + np.clip(u @ w, *((-np.inf, np.inf) if m.bound is None else (-m.bound, m.bound)))
        return out

    out = solved(keep)
    if m.regime is not None:
        level = v[:, gr.OWN.index("log_RV22")]
        cut = np.quantile(level[:t], m.regime)
        for on in (level <= cut, level > cut):
            if on[:t].sum() >= 30:
                out = np.where(on, solved(on[:t]), out)
    return out[t:]


CHOSEN = ("HAR", "HAR (no outliers)", "HAR-Lasso (a=0.1)", "RegHAR (p75)", "RegHAR (p90)", "RegHAR-Lasso (p50)", "NetHAR (OLS)", "NetHAR (Lasso a=0.05) (no outliers)", "NetHAR (Ridge a=1.0)", "NetworkVAR (a=0.1, b=0.5)", "NetworkVAR (a=0.0, b=None) (no outliers)", "NetworkVAR-Split (a=0.1, b=1.0)", "NetHAR+CSplit (Lasso a=0.1)", "LearnedW (m=1, Ridge a=1.0)", "LearnedW+C (m=2, Lasso a=0.01)")


def test_linear_models_of_all_graphs(spark, made):
    panel, nets, plain = made
    its = {g: [m for m in own if m.name in CHOSEN] for g, own in gr.catalogue(GRAPHS).items()}
    run = gr.Evaluation(panel, nets, its, 1, TEST, TRAIN)
    chosen = [m for own in its.values() for m in own]
    got = run.predictions(chosen).toPandas()
    scored = run.metrics().toPandas().set_index(["category", "model", "series"])
    assert len(got) == 2 * TEST * len(chosen) and len(scored) == 2 * len(chosen) and len({m.name for m in chosen}) == len(CHOSEN)
    for graph, own in its.items():
        for m in own:
            for s, (v, y) in plain.items():
                rows = got[(got["category"] == m.category) & (got["model"] == m.name) & (got["series"] == s)].sort_values("dt")
                want = plain_linear(graph, m, v[graph], y, N - TEST)
                assert np.allclose(np.log(rows["y_pred"]), want, atol=1e-6), m
                assert abs(scored.loc[(m.category, m.name, s), "RMSE_log"] - np.sqrt(np.mean((y[-TEST:] - want) ** 2))) < 1e-6
    again = reports.regression_metrics(spark.createDataFrame(got), ["category", "model", "series", "fold"]).toPandas().set_index(["category", "model", "series"])
    for c in ("R2", "RMSE", "MAE", "R2_log", "RMSE_log", "MAE_log"):
        assert np.allclose(again[c].sort_index(), scored[c].sort_index(), atol=1e-9)


def plain_logit(graph, m, v, y, label, t, least=30):
    keep = usual(v[:t], y[:t]) if m.clean else np.ones(t, bool)

    def solved(rows):
        if m.learned:
            x, weights = design(graph, m, v[:t][rows], None)
            z = design(graph, m, v, weights)[0]
        else:
            z = take(graph, v, m.own)
            x = z[:t][rows]
        scale = timeseries.Scaled(x)
        b = timeseries.fit_logit(scale(x), label[:t][rows], m.c)
        odds = scale(z) @ b[1:] + b[0]
        if m.net:
            n = take(graph, v, m.net)
            second = timeseries.Scaled(n[:t][rows])
            u, e = second(n), label[:t][rows] - spikes.sigmoid(odds[:t][rows])
            w = np.linalg.solve(u[:t][rows].T @ u[:t][rows] + m.stage2 * np.eye(u.shape[1]), u[:t][rows].T @ (e - e.mean()))
            odds = odds + np.clip(u @ w + e.mean(), -m.bound, m.bound)
        return odds

    out = solved(keep)
    if m.regime is not None:
        level = v[:, gr.OWN.index("log_RV22")]
        cut = np.quantile(level[:t], m.regime)
        for on in (level <= cut, level > cut):
            own = on[:t]
            if own.sum() >= least and len(set(label[:t][own])) == 2:
                out = np.where(on, solved(own), out)
    return spikes.sigmoid(out[t:])


LOGITS = ("HAR-Logit (C=0.01)", "HAR-Ext-Logit (C=10.0)", "HAR-Logit (C=1.0, no-out)", "RegHAR-Logit (p50)", "RegHAR-Logit (p75)", "RegHAR-Logit (p50, C=0.1)", "NetHAR-Logit (C=100.0)", "NetHAR+C-Logit (C=1.0) (no outliers)", "NetVAR-Logit (C=1,a=0.01,b=1)", "NetVAR-Logit (C=10,a=0.5,b=2) (no outliers)", "NetVAR+CSplit-Logit (C=1,a=0.1,b=1)", "LearnedW-Logit (m=1, C=1.0)", "LearnedW+C-Logit (m=2, C=10.0) (no outliers)")


@pytest.mark.parametrize("block", [64, 10_000])
def test_logits_are_merged_over_blocks_of_dates(spark, made, block):
    """Every kind of logit, with a series' rows in one block and split over many tasks."""
    panel, nets, plain = made
    its = {g: [m for m in own if m.name in LOGITS] for g, own in spikes.catalogue(GRAPHS).items()}
    study = spikes.Study(panel.repartition(7), nets, its, 1, TEST, TRAIN, block=block)
    got = study.predictions().toPandas()
    assert len(got) == 2 * TEST * sum(map(len, its.values())) and len(set(got["model"])) == len(LOGITS)
    if block == 64:
        assert study.blocks.where("role = 'train'").count() >= 2 * 9
    for graph, own in its.items():
        for m in own:
            for s, (v, y) in plain.items():
                label = (np.exp(y) > np.quantile(np.exp(y[: N - TEST]), 0.8)).astype(int)
                rows = got[(got["category"] == m.category) & (got["model"] == m.name) & (got["series"] == s)].sort_values("dt")
                assert (rows["label"].to_numpy() == label[-TEST:]).all()
                assert np.allclose(rows["proba"], plain_logit(graph, m, v[graph], y, label, N - TEST), atol=1e-6), m
    params = study.parameters().where("category = 'HAR-Logit' and series = 'a' and part = 'all' and model = 'HAR-Logit (C=0.01)'").toPandas()
    x = take("", plain["a"][0][""], fc.har_features())[: N - TEST]
    assert np.allclose(params[params["kind"] == "mean"]["value"], x.mean(0)) and np.allclose(params[params["kind"] == "scale"]["value"], x.std(0))


def test_one_class_has_no_logit(spark, made):
    panel, nets, _ = made
    flat = panel.withColumn("Y_fwd", F.lit(1.0))
    its = {"": [spikes.Logit("c", "m", ("log_RV1",))]}
    study = spikes.Study(flat, nets.withColumn("net", F.array().cast("array<double>")), its, 1, TEST, TRAIN)
    assert study.predictions().count() == 0


def test_catalogue_sizes_of_all_graphs():
    graphs = [(kind, k) for kind in gr.KINDS for k in range(1, 6)]
    linear, logits = gr.catalogue(graphs), spikes.catalogue(graphs)
    assert sum(map(len, linear.values())) == 2163
    assert [len(spikes.network_models("n", *s)) // 2 for s in ((False, False), (True, False), (False, True), (True, True))] == [11, 8, 7, 6]
    assert len(spikes.baselines()) == 13 and sum(map(len, logits.values())) == 1433
    names = {m.name for own in [*linear.values(), *logits.values()] for m in own}
    assert {"NetHAR (Ridge a=0.10)", "NetHAR (Ridge a=1.0)", "NetworkVAR+CSplit (a=0.1,b=None)", "NetHAR+CSplit (Lasso a=0.1)", "LearnedW (m=1, Ridge a=1.0)", "NetVAR-Logit (C=1,a=0.01,b=1)", "LearnedW-Logit (m=2, C=100.0)"} <= names


def test_many_solves_are_single_solves():
    r = np.random.default_rng(3)
    problems, want = [], []
    for i in range(60):
        p, n = int(r.integers(1, 9)), 200
        x = r.normal(size=(n, p)) @ (np.eye(p) + r.normal(size=(p, p)) * (i % 3))
        y = x @ (r.normal(size=p) * (r.random(p) < 0.5)) + r.normal(size=n)
        c = x - x.mean(0)
        g = models.Gram.whole(n, np.append(x.mean(0), y.mean()), np.cov(np.column_stack((x, y)).T, bias=True).reshape(p + 1, p + 1) * n)
        args = [{}, {"ridge": 2.0}, {"lasso": 0.1}][i % 3]
        problems.append(g.problem(np.arange(p), **args))
        want.append((args, c / c.std(0), y - y.mean(), c.std(0)))
    models.solve_all(problems)
    for s, (args, z, y, sd) in zip(problems, want, strict=True):
        beta = s.coef * sd
        slope = z.T @ (y - z @ beta)
        if "lasso" in args:
            limit = len(z) * 0.1
            assert (np.abs(slope) <= limit * (1 + 1e-6)).all() and np.allclose(slope[beta != 0], limit * np.sign(beta[beta != 0]), rtol=1e-5)
        else:
            assert np.allclose(slope, args.get("ridge", 0) * beta, atol=1e-6)


def test_graphs_of_all_k_are_the_single_graphs(spark):
    """Levels, and features computed for all graphs at once, against one graph at a time."""
    r = np.random.default_rng(9)
    frame = pd.DataFrame([(f"s{j:02d}", i, float(v)) for j in range(12) for i, v in enumerate(r.normal(size=90), 1)], columns=["series", "i", "Returns"])
    panel = spark.createDataFrame(frame).withColumns({c: F.col("Returns") * n for n, c in enumerate(network.VALUES[:3], 1)})
    pairs = gr.distances(panel, ("sqcorr", "mi", "exp")).cache()
    edges = gr.all_edges(gr.levelled(pairs), pairs, (1, 3), stride=2).cache()
    got = gr.all_features(pairs, edges, panel, (1, 3), 5, most=3).toPandas()
    rho = network.squared_distance(network.correlations(panel, 60, 5))
    for kind, k in (("sqcorr", 1), ("sqcorr", 3), ("exp", 3), ("mi", 3)):
        own = pairs.where(F.col("kind") == kind).drop("kind")
        one = network.graph_features(rho, network.knn_edges(own, k), panel, 3, 5, kernel="exp" if kind == "exp" else "inverse", stride=2)
        want = one.select("snapshot", "src", *gr.net_names(3)).toPandas().sort_values(["snapshot", "src"]).reset_index(drop=True)
        have = got[(got["kind"] == kind) & (got["k"] == k)].sort_values(["snapshot", "src"]).reset_index(drop=True)[want.columns]
        pd.testing.assert_frame_equal(have, want, check_dtype=False, atol=1e-9)


def test_values_are_carried_over_blocks(spark):
    r = np.random.default_rng(4)
    frame = pd.DataFrame({"s": np.repeat(["a", "b"], 300), "i": np.tile(np.arange(300), 2), "x": np.where(r.random(600) < 0.03, r.normal(size=600), np.nan), "y": np.where(r.random(600) < 0.5, 1.0, np.nan)})
    rows = spark.createDataFrame(frame).select("s", "i", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"))
    got = network.carried(rows, ["s"], "i", ["x", "y"], size=16).toPandas().sort_values(["s", "i"])
    want = frame.groupby("s")[["x", "y"]].ffill()
    assert np.allclose(got[["x", "y"]], want, equal_nan=True)


def test_triangles_around_a_hub(spark):
    r = np.random.default_rng(5)
    n = 300
    pairs = {(0, i) for i in range(1, n)} | {tuple(sorted(p)) for p in r.integers(1, n, (900, 2)).tolist() if p[0] != p[1]}
    a = np.zeros((n, n), int)
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    rows = [(1, f"{i:03d}", f"{j:03d}") for i, j in pairs] + [(1, f"{j:03d}", f"{i:03d}") for i, j in pairs]
    edges = spark.createDataFrame(rows, "snapshot int, src string, dst string").cache()
    got = {x["src"]: x["t"] for x in network.triangles(edges).collect()}
    assert [got.get(f"{i:03d}", 0) for i in range(n)] == (np.diag(a @ a @ a) // 2).tolist()
