"""Forecasting models fitted for all series and folds as Spark jobs.

One centred cross-product matrix per key serves every linear model: the rows are read once, partial
matrices of the tasks are merged, and the small solves run on one row per key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def naive_week(horizon: int = 5) -> Column:
    return horizon * F.col("RV5")


def naive_month(horizon: int = 5) -> Column:
    return horizon * F.col("RV22")


def ewma_variance(df: DataFrame, decay: float = 0.94, seed_rows: int = 50) -> DataFrame:
    """s_i = decay * s_(i-1) + (1 - decay) * r_(i-1)^2, seeded with the mean of the first rows, as
    weighted running sums inside blocks over which decay falls to 1e-100: of what is older than the
    block before nothing is left in double precision, so series of any length stay in range."""
    size = max(1, math.floor(100 * math.log(10) / -math.log(decay)))
    w = Window.partitionBy("series").orderBy("dt")
    rows = df.where("Returns is not null").withColumn("j", F.row_number().over(w) - 1).withColumn("r2", F.col("Returns") ** 2)
    rows = rows.withColumn("b", F.floor(F.col("j") / size)).withColumn("k", F.col("j") % size)
    seed = F.avg(F.when(F.col("j") < seed_rows, F.col("r2"))).over(Window.partitionBy("series"))
    inside = Window.partitionBy("series", "b").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.sum(F.col("r2") * F.pow(F.lit(decay), -F.col("k"))).over(inside), F.lit(0.0))
    within = (1 - decay) * F.pow(F.lit(decay), F.col("k") - 1) * past
    # what a block hands to the next: its rows' sum, and the seed's remainder in the first
    ends = rows.groupBy("series", (F.col("b") + 1).alias("b")).agg(((1 - decay) * decay ** (size - 1) * F.sum(F.col("r2") * F.pow(F.lit(decay), -F.col("k")))).alias("handed"))
    start = F.when(F.col("b") == 0, F.col("seed")).otherwise(F.col("handed"))
    rows = rows.withColumn("seed", seed).withColumn("within", within).join(ends, ["series", "b"], "left")
    return rows.withColumn("ewma", F.pow(F.lit(decay), F.col("k")) * start + F.col("within")).drop("j", "r2", "b", "k", "seed", "within", "handed")


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)


def _merge(one: tuple, two: tuple) -> tuple:
    """n, means and centred cross products of two disjoint parts together."""
    (n, m, c), (k, u, d) = one, two
    gap = u - m
    return n + k, m + gap * (k / (n + k)), c + d + np.outer(gap, gap) * (n * k / (n + k))


def gram(train: DataFrame, keys: list[str], columns: list[str], target: str, most_keys: int = 20_000) -> DataFrame:
    """Per key: n, means and the centred cross products (upper triangle) of columns and target, as
    arrays. Every task merges its own rows' parts, `most_keys` keys at a time, so a key has about one
    part for each task, and the parts are merged once more. Rows with a missing value do not count."""
    names = [*columns, target]
    rows = train.dropna(subset=names).select(*keys, F.array(*(F.col(c).cast("double") for c in names)).alias("v"))
    upper = np.triu_indices(len(names))
    kinds = f"{_kinds(rows, keys)}, n long, mean array<double>, cross array<double>"

    def frame(parts: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(parts), columns=keys)
        out["n"] = [n for n, _, _ in parts.values()]
        out["mean"] = [m.tolist() for _, m, _ in parts.values()]
        out["cross"] = [c[upper].tolist() for _, _, c in parts.values()]
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict = {}
        for b in batches:
            for key, own in b.groupby(keys, sort=False):
                x = np.stack(own["v"])
                m = x.mean(0)
                part = (len(x), m, (x - m).T @ (x - m))
                parts[key] = _merge(parts[key], part) if key in parts else part
            if len(parts) > most_keys:
                yield frame(parts)
                parts = {}
        if parts:
            yield frame(parts)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        got = None
        for n, m, c in zip(pdf["n"], pdf["mean"], pdf["cross"], strict=True):
            full = np.zeros((len(names),) * 2)
            full[upper] = c
            full = full + np.triu(full, 1).T
            got = (n, np.asarray(m), full) if got is None else _merge(got, (n, np.asarray(m), full))
        return frame({tuple(pdf[keys].iloc[0]): got})

    return rows.mapInPandas(partial, kinds).groupBy(*keys).applyInPandas(whole, kinds)


class Gram:
    """A key's cross products, with the standardised solves that every linear model is made of."""

    def __init__(self, n: int, mean, cross):
        p = len(mean)
        g = np.zeros((p, p))
        g[np.triu_indices(p)] = cross
        self.n, self.mean, self.g = int(n), np.asarray(mean, float), g + np.triu(g, 1).T

    @classmethod
    def whole(cls, n: int, mean: np.ndarray, g: np.ndarray) -> Gram:
        """From the full matrix."""
        out = cls.__new__(cls)
        out.n, out.mean, out.g = int(n), mean, g
        return out

    def problem(self, at: np.ndarray, target: np.ndarray | None = None, ridge: float = 0.0, lasso: float = 0.0, turn: np.ndarray | None = None) -> Standard:
        """The regression of the columns `at` (or of linear combinations of them, rows of `turn`) on the
        cross products `target` (with the last column if None)."""
        a = self.g[np.ix_(at, at)]
        b = self.g[at, -1] if target is None else target
        if turn is not None:
            a, b = turn @ a @ turn.T, turn @ b
        return Standard(self.n, a, b, ridge, lasso, turn)

    def solve(self, *args, **more) -> np.ndarray:
        """Coefficients of `problem`, on the original scale."""
        one = self.problem(*args, **more)
        solve_all([one])
        return one.coef


class Standard:
    """A regression on standardised columns: cross products, right side, penalties; `coef`, on the
    original scale, once `solve_all` has been through."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, ridge: float, lasso: float, turn: np.ndarray | None):
        sd = np.sqrt(np.maximum(np.diag(a), 0) / n)
        sd[sd <= 1e-12] = 1
        self.n, self.a, self.b, self.sd, self.ridge, self.lasso, self.turn = n, a / np.outer(sd, sd), b / sd, sd, ridge, lasso, turn
        self.coef = np.zeros(0)

    def take(self, beta: np.ndarray) -> None:
        self.beta = beta  # of the standardised columns
        beta = beta / self.sd
        self.coef = beta if self.turn is None else self.turn.T @ beta


def solve_all(problems: list[Standard]) -> None:
    """Solve many small regressions; those of one size and kind in one call."""
    groups: dict[tuple, list[Standard]] = {}
    for s in problems:
        groups.setdefault((len(s.b), "lasso" if s.lasso else "ridge" if s.ridge else "plain"), []).append(s)
    for (p, kind), own in groups.items():
        a, b = np.stack([s.a for s in own]), np.stack([s.b for s in own])
        if kind == "lasso":
            beta = _lasso(a, b, np.array([s.n * s.lasso for s in own]))
        elif kind == "ridge":
            beta = np.linalg.solve(a + np.array([s.ridge for s in own])[:, None, None] * np.eye(p), b[..., None])[..., 0]
        else:  # the shortest solution where columns depend on each other
            beta = (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b[..., None])[..., 0] if p else b
        for s, v in zip(own, beta, strict=True):
            s.take(v)


def _lasso(a: np.ndarray, b: np.ndarray, limit: np.ndarray, rounds: int = 20_000, every: int = 10) -> np.ndarray:
    """Coordinate descent on the cross products of all problems at once. Every so often the equations of
    the columns that take part are solved with the signs they have; where that is the optimum (signs
    stay, and no other column's slope exceeds the limit) the problem is done."""
    beta, out = np.zeros_like(b), np.zeros_like(b)
    left = np.arange(len(b))
    rest, own = b.copy(), np.einsum("ijj->ij", a).copy()
    for turn in range(rounds):
        before = beta.copy()
        for j in range(b.shape[1]):
            d = own[:, j]
            z = rest[:, j] + d * beta[:, j]
            new = np.where(d > 0, np.sign(z) * np.maximum(np.abs(z) - limit, 0) / np.where(d > 0, d, 1), 0)
            rest -= a[:, :, j] * (new - beta[:, j])[:, None]
            beta[:, j] = new
        done = np.abs(beta - before).max(1, initial=0) < 1e-9
        found = beta
        if turn % every == every - 1:
            on = beta != 0
            m = a * (on[:, :, None] & on[:, None, :])
            np.einsum("ijj->ij", m)[...] += ~on
            sign = np.sign(beta)
            rhs = np.where(on, b - limit[:, None] * sign, 0)
            try:
                exact = np.linalg.solve(m, rhs[..., None])[..., 0]
            except np.linalg.LinAlgError:
                exact = beta
            slope = b - (a @ exact[..., None])[..., 0]
            good = (np.where(on, np.sign(exact) == sign, True) & (np.abs(np.where(on, slope - limit[:, None] * sign, 0)) <= 1e-7 * limit[:, None]) & (np.abs(np.where(on, 0, slope)) <= limit[:, None] * (1 + 1e-9))).all(1)
            found = np.where(good[:, None], exact, beta)
            done |= good
        if done.any():
            out[left[done]] = found[done]
            keep = ~done
            left, a, b, limit, beta, rest, own = (v[keep] for v in (left, a, b, limit, beta, rest, own))
            if not len(left):
                return out
    out[left] = beta
    return out


def solve_one(n: int, mean: np.ndarray, cross: np.ndarray, ridge: float = 0.0, lasso: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients on the original scale and intercept, of standardised columns."""
    g = Gram(n, mean, cross)
    coef = g.solve(np.arange(len(mean) - 1), ridge=ridge, lasso=lasso)
    return coef, float(g.mean[-1] - coef @ g.mean[:-1])


def fit_linear(grams: DataFrame, keys: list[str], ridge: float = 0.0, lasso: float = 0.0) -> DataFrame:
    """keys, coef, intercept: one small solve per row."""

    def run(batches):
        for b in batches:
            got = [solve_one(n, m, c, ridge, lasso) for n, m, c in zip(b["n"], b["mean"], b["cross"], strict=True)]
            yield pd.DataFrame({**{k: b[k] for k in keys}, "coef": [c.tolist() for c, _ in got], "intercept": [i for _, i in got]})

    return grams.mapInPandas(run, f"{_kinds(grams, keys)}, coef array<double>, intercept double")


def predict_linear(test: DataFrame, models: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds y_pred = exp(intercept + coef . columns)."""
    value = F.col("intercept")
    for i, c in enumerate(columns):
        value = value + F.element_at("coef", i + 1) * F.col(c)
    return test.dropna(subset=columns).join(models, keys).withColumn("y_pred", F.exp(value)).drop("coef", "intercept")
