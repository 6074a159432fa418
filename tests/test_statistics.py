"""Exact quantiles, lag products and tiled networks against direct computations."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltide.operators import eda, network
from voltide.operators.quantiles import quantiles

SHARES = [0.0, 0.01, 0.5, 0.777, 1.0]


@pytest.mark.parametrize("few", [1, 40, 1_000_000])
def test_quantiles_by_counting(spark, few):
    """Ties, one value, few values, far apart and close ones: the same as sorted."""
    r = np.random.default_rng(2)
    groups = {
        "normal": r.normal(size=3000),
        "ties": r.integers(0, 4, 2000).astype(float),
        "one": np.full(500, 3.5),
        "single": np.array([7.0]),
        "pair": np.array([1.0, 2.0]),
        "far": np.concatenate((r.normal(size=900) * 1e-12, [1e200, -1e150, 5e-324, 1e308, -1e308])),
        "close": 1 + np.arange(300) * 2.0**-52,
    }
    frame = pd.DataFrame([(k, v) for k, x in groups.items() for v in x] + [("normal", None), ("none", None)], columns=["k", "x"])
    rows = spark.createDataFrame(frame, "k string, x double").where("x is null or not isnan(x)").repartition(5)
    got = {x["k"]: x["q"] for x in quantiles(rows, ["k"], "x", SHARES, few).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        s = np.sort(x)
        at = np.array(SHARES) * (len(s) - 1)
        low, high = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
        with np.errstate(over="ignore"):
            want = low + (high - low) * (at - np.floor(at))
        ok = np.isfinite(want)
        assert np.allclose(np.array(got[k])[ok], want[ok], rtol=1e-12, atol=0), k
    pooled = quantiles(rows.where("k in ('normal', 'ties')"), [], "x", SHARES, few).first()["q"]
    assert np.allclose(pooled, np.quantile(np.concatenate((groups["normal"], groups["ties"])), SHARES))
    assert quantiles(rows.limit(0), ["k"], "x", SHARES, few).count() == 0


def test_lag_products_over_blocks(spark):
    r = np.random.default_rng(6)
    x = {"a": r.normal(size=700).cumsum(), "b": r.normal(size=30), "c": np.array([1.0, 2.0])}
    frame = pd.DataFrame([(k, pd.Timestamp("2000-01-01") + pd.Timedelta(days=3 * i), v) for k, v in x.items() for i, v in enumerate(v)], columns=["series", "dt", "Returns"])
    rows = spark.createDataFrame(frame).withColumn("dt", F.col("dt").cast("date"))
    numbers = eda.numbered(rows).toPandas().sort_values(["series", "dt"])
    assert (numbers["j"].to_numpy() == np.concatenate([np.arange(1, len(v) + 1) for v in x.values()])).all()
    got = {(y["series"], y["lag"]): y["acf"] for y in eda.autocorrelation(rows, lags=20, size=64).collect()}
    want = {}
    for k, v in x.items():
        c = v - v.mean()
        want |= {(k, n): (c[n:] * c[:-n]).sum() / (c * c).sum() for n in range(1, 21) if n < len(v)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_windows(frame, window, step):
    wide = frame.pivot(index="i", columns="series", values="Returns")
    for end in range(step * -(-window // step), len(wide) + 1, step):
        own = wide.iloc[end - window : end]
        kept = own.columns[own.notna().sum() >= 0.8 * window]
        if len(kept) >= 10:
            yield end, own[kept].fillna(0.0)


def test_tiles_hold_every_pair_once(spark):
    """More series than a tile and more dates than a span, gaps, a constant stretch, a late series."""
    r = np.random.default_rng(7)
    n, p = 160, 23
    x = r.normal(size=(n, p)) + r.normal(size=(n, 1))
    x[:, 1] = np.round(x[:, 1])
    x[60:150, 4] = 0.5
    x[:70, 5] = np.nan
    x[r.random((n, p)) < 0.02] = np.nan
    frame = pd.DataFrame([(f"s{j * 7 % p:02d}", i + 1, x[i, j]) for j in range(p) for i in range(n)], columns=["series", "i", "Returns"])
    panel = spark.createDataFrame(frame).withColumn("Returns", F.when(~F.isnan("Returns"), F.col("Returns"))).withColumn("i", F.col("i").cast("int"))
    want, zero = {}, 0
    for end, own in plain_windows(frame, 60, 5):
        m = own.to_numpy()
        rho = network.safe_correlation(m)
        zero += (rho == np.eye(len(rho))).all()
        want |= {(end, a, b): rho[i, j] for i, a in enumerate(own.columns) for j, b in enumerate(own.columns) if a < b}
    held = network.windows(panel, 60, 5)
    for found in (network.correlations(panel, 60, 5, tile=5, span=11), network.pair_correlations(held, tile=5)):
        rows = found.collect()
        got = {(y["snapshot"], y["s1"], y["s2"]): y["rho"] for y in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and 0 < zero < 18
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    one, many = (network.mutual_information(held, tile=t).toPandas().sort_values(["snapshot", "s1", "s2"]).reset_index(drop=True) for t in (128, 4))
    pd.testing.assert_frame_equal(one, many)
    assert len(one) == len(want)
    bins = network.rank_bins(held).where("snapshot = 100").toPandas().pivot(index="i", columns="series", values="bin")
    for row in one[one["snapshot"] == 100].itertuples():
        c = pd.crosstab(bins[row.s1], bins[row.s2]).to_numpy() / 60
        e = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
        assert abs(row.nmi - np.clip((e(c.sum(0)) + e(c.sum(1)) - e(c)) / np.sqrt(e(c.sum(0)) * e(c.sum(1))), 0, 1)) < 1e-9


def test_plan_of_correlations_has_no_row_for_a_pair_and_date(spark):
    panel = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.1)], "series string, i int, Returns double")
    plan = network.correlations(panel)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :].split("\n", 1)[1]
    assert not re.search(r"\bs[12]#", below)
