"""Spike classification for all series and folds: logits on HAR, network and learned columns.

A spike is a target beyond a quantile of its fold's training rows. Logits are fitted by Newton steps
over all rows: a step reads the rows in blocks of dates, each task adds up the losses, slopes and
curvatures of all models that are not done yet, and only these sums are merged, by series and fold. What
a model's columns are scaled and turned by comes from the cross products of `graphs.cells`, so no
task ever holds a series.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators import forecasting as fc
from voltide.operators import graphs as gr
from voltide.operators.models import Gram
from voltide.operators.network import VALUES
from voltide.operators.quantiles import quantiles
from voltide.sources.store import discard, written


@dataclass(frozen=True)
class Logit:
    """One entry of the catalogue; the fields are those of `forecasting.Model`, with `c` the inverse
    strength of the penalty."""

    category: str
    name: str
    own: tuple[str, ...]
    c: float = 1.0
    net: tuple[str, ...] = ()
    stage2: float = 0.0
    bound: float = 2.0
    learned: int = 0
    k: int = 0
    regime: float | None = None
    clean: bool = False

    @property
    def columns(self) -> list[str]:
        ranks = [f"net_nn{r}_{c}" for r in range(self.k) for c in VALUES] if self.learned else []
        return fc.unique([*self.own, *self.net, *ranks])


def _twins(models: list[Logit]) -> list[Logit]:
    return [m for own in models for m in ([own] if own.clean else [own, replace(own, name=f"{own.name} (no outliers)", clean=True)])]


# C of the one-stage logits, and (C, a, b) of the two-stage ones, by structure.
PLAIN, CLUSTERED, SPLIT, BOTH = (False, False), (True, False), (False, True), (True, True)
STRENGTHS = {PLAIN: (0.1, 1.0, 10.0, 100.0), CLUSTERED: (0.1, 1.0, 10.0, 100.0), SPLIT: (0.1, 1.0, 10.0, 100.0), BOTH: (0.1, 1.0, 10.0)}
STAGES = {
    PLAIN: ((1, 0.1, 1), (1, 0.5, 2), (1, 1.0, 2), (1, 0.01, 1), (10, 0.1, 1), (10, 0.5, 2), (10, 1.0, 2)),
    CLUSTERED: ((1, 0.1, 1), (1, 0.5, 2), (10, 0.1, 1), (10, 0.5, 2)),
    SPLIT: ((1, 0.1, 1), (1, 0.5, 2), (10, 0.1, 1)),
    BOTH: ((1, 0.1, 1), (1, 0.5, 2), (10, 0.1, 1)),
}
LEARNED = (0.1, 1.0, 10.0, 100.0)


def baselines(market: bool = True) -> list[Logit]:
    har, ext = tuple(fc.har_features(market=market)), tuple(fc.har_features(True, market))
    out = []
    for name, own in (("HAR-Logit", har), ("HAR-Ext-Logit", ext)):
        out += [Logit(name, f"{name} (C={c})", own, c) for c in (0.01, 0.1, 1.0, 10.0)] + [Logit(name, f"{name} (C=1.0, no-out)", own, clean=True)]
    out += [Logit("RegimeSwitching-Logit", f"RegHAR-Logit ({end})", har, c, regime=q) for end, c, q in (("p50", 1.0, 0.5), ("p75", 1.0, 0.75), ("p50, C=0.1", 0.1, 0.5))]
    return out


def network_models(category: str, clustering: bool = False, split: bool = False, market: bool = True) -> list[Logit]:
    end = {PLAIN: "", CLUSTERED: "+C", SPLIT: "-Split", BOTH: "+CSplit"}[clustering, split]
    har, net = tuple(fc.har_features(True, market, True)), tuple(fc.net_features(clustering, split))
    one = [Logit(category, f"NetHAR{end}-Logit (C={c})", har + net, c) for c in STRENGTHS[clustering, split]]
    two = [Logit(category, f"NetVAR{end}-Logit (C={c},a={a},b={b})", har, float(c), net, a, float(b)) for c, a, b in STAGES[clustering, split]]
    return _twins(one + two)


def learned_models(category: str, k: int, clustering: bool = False, market: bool = True) -> list[Logit]:
    own = tuple(fc.unique(fc.har_features(True, market, True) + fc.STRUCTURE + (fc.CLUSTERING if clustering else [])))
    end = "+C" if clustering else ""
    return _twins([Logit(category, f"LearnedW{end}-Logit (m={m}, C={c})", own, c, learned=m, k=k) for m in range(1, k) for c in LEARNED])


def catalogue(graphs: list[tuple[str, int]], market: bool = True) -> dict[str, list[Logit]]:
    """The logits by graph; those without a graph under the empty name."""
    out: dict[str, list[Logit]] = {"": baselines(market)}
    for kind, k in graphs:
        own = out.setdefault(gr.graph_id(kind, k), [])
        for part, names in gr.CATEGORIES.items():
            if kind in names:
                category = f"{names[kind]} [k={k}]"
                if part.startswith("learned"):
                    own += learned_models(category, k, clustering=part == "learned+", market=market)
                else:
                    own += network_models(category, clustering=part in ("clustering", "both"), split=part in ("split", "both"), market=market)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


class Design:
    """What a model's columns become on one part: turned, by the mean and population deviation (0 counts
    as 1) of the part's rows. `rows` tells the part's rows."""

    def __init__(self, g: Gram, m: Logit, part: str, place: dict[str, int], columns: tuple[str, ...]):
        self.part = part
        self.weights = fc.learned_weights(g, m, place) if m.learned else None
        turn = fc._turn(m, self.weights) if m.learned else np.eye(len(columns))
        at = [place[c] for c in columns]
        self.names = [*columns] if not m.learned else [*m.own, *(f"z{i}_{c}" for c in VALUES for i in range(m.learned))]
        self.mean = turn @ g.mean[at]
        sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", turn, g.g[np.ix_(at, at)], turn), 0) / g.n)
        self.sd = np.where(sd <= 1e-12, 1.0, sd)
        self.at, self.turn = at, turn

    def of(self, v: np.ndarray) -> np.ndarray:
        """The scaled columns of rows, a column of ones in front."""
        z = (v[:, self.at] @ self.turn.T - self.mean) / self.sd
        return np.column_stack((np.ones(len(v)), z))

    def rows(self, usual: np.ndarray, bin_: np.ndarray, quantiles: list[float]) -> np.ndarray:
        if self.part in ("all", "usual"):
            return usual | (self.part == "all")
        q, high = self.part.split("/")
        return (bin_ > [f"{x:g}" for x in quantiles].index(q)) == (high == "1")


class Fits:
    """All logits of one series and fold that share a design: coefficients, the last accepted ones, and
    how far the search is. One that is done is left alone."""

    def __init__(self, graph: str, models: list[Logit], design: Design, n: int):
        self.graph, self.models, self.design, self.n = graph, models, design, n
        p = len(design.names) + 1
        self.c = np.array([m.c for m in models])
        self.beta, self.good = np.zeros((len(models), p)), np.zeros((len(models), p))
        self.move, self.size = np.zeros((len(models), p)), np.ones(len(models))
        self.loss = np.full(len(models), np.inf)
        self.done = np.zeros(len(models), bool)
        self.positive = 0
        self.second: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]] = {}

    def sums(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Loss, slope and curvature of the open models over some rows, and the number of positives."""
        on = np.flatnonzero(~self.done)
        z = x @ self.beta[on].T
        p = sigmoid(z)
        loss = np.logaddexp(0, np.where(y[:, None] == 1, -z, z)).sum(0)
        bend = (x.T[None] * (p * (1 - p)).T[:, None, :]) @ x
        return [np.array(float(y.sum())), loss, (p - y[:, None]).T @ x, bend]

    def step(self, positive: float, loss: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> None:
        """One Newton step, halved while the aim rises: c * loss + half the coefficients' squares, without
        the intercept's."""
        self.positive = positive
        on = np.flatnonzero(~self.done)
        if not 0 < positive < self.n:  # one class
            self.done[:] = True
            return
        c, b = self.c[on], self.beta[on]
        free = np.ones(b.shape[1])
        free[0] = 0
        aim = c * loss + (b**2 * free).sum(1) / 2
        worse = aim > self.loss[on] + 1e-12 * np.maximum(1, np.abs(self.loss[on]))
        better = ~worse
        gained = np.where(np.isfinite(self.loss[on]), self.loss[on] - aim, np.inf)
        self.done[on] = better & (gained < 1e-12 * np.maximum(1, np.abs(aim)))
        # rejected steps are halved; beyond a millionth the last good place is kept
        self.size[on[worse]] /= 2
        stuck = on[worse & (self.size[on] < 1e-6)]
        self.beta[stuck], self.done[stuck] = self.good[stuck], True
        good = on[better]
        self.good[good], self.loss[good], self.size[good] = self.beta[good], aim[better], 1.0
        h = c[better, None, None] * bend[better] + np.diag(free) + 1e-10 * np.eye(len(free))
        self.move[good] = np.linalg.solve(h, (c[better, None] * slope[better] + free * b[better])[..., None])[..., 0]
        go = on[~self.done[on]]
        self.beta[go] = self.good[go] - self.size[go, None] * self.move[go]

    @property
    def fitted(self) -> bool:
        return 0 < self.positive < self.n


def _add(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """series, fold, role and some dates' rows as one packed matrix each: usual, bin, label, then the own
    columns and the target, then the graphs' columns; dt and Y_fwd beside it."""
    keys = ["series", "fold", "role", "block"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        own = np.column_stack((pdf["usual"], pdf["bin"], pdf["label"], np.stack(pdf["x"])))
        net = np.stack(pdf["net"]) if len(pdf["net"].iloc[0]) else np.zeros((len(pdf), 0))
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "fold": pdf["fold"].iloc[:1], "role": pdf["role"].iloc[:1], "n": len(pdf), "v": [np.hstack((own, net)).astype("<f8").tobytes()], "dt": [list(pdf["dt"])], "y": [list(pdf["Y_fwd"])]})

    rows = rows.withColumn("block", F.floor(F.col("i") / size))
    return rows.groupBy(*keys).applyInPandas(pack, "series string, fold int, role string, n int, v binary, dt array<date>, y array<double>")


class Study:
    """Logits of a catalogue fitted on a panel with the arrays of `graphs.packed`."""

    def __init__(self, panel: DataFrame, nets: DataFrame, models: dict[str, list[Logit]], n_splits: int = 1, test: int = 252, min_train: int = 1260, quantile: float = 0.8, lookback: int | None = None, least: int = 30, step: int = 5, own: list[str] = gr.OWN, most: int = gr.MOST, block: int = 512, steps: int = 60):
        self.models, self.own, self.names, self.least = models, own, gr.net_names(most), least
        self.graphs = [g for g in models if g]
        self.quantiles = sorted({m.regime for its in models.values() for m in its if m.regime is not None} | {0.5})
        rows = written(gr.joined(panel.where("Y_fwd is not null"), nets, n_splits, test, min_train, step, own))
        train = rows.where("role = 'train'")
        limits = self.limits = written(fc.thresholds(train, self.quantiles))
        found = gr.cells(train, limits, len(own) + 1, len(self.graphs), len(self.names))
        state = written(found.groupBy("series", "fold").applyInPandas(self._start(), "series string, fold int, state binary, left int"))
        self.blocks = written(_blocks(_labelled(rows, train, limits, quantile, lookback), block))
        own_rows = self.blocks.where("role = 'train'").select("series", "fold", "n", "v")
        for _ in range(steps):
            if not state.where("left > 0").limit(1).count():
                break
            state = written(self._merged(own_rows, state, self._sums("step"), self._update()), state)
        self.state = written(self._merged(own_rows, state, self._sums("second"), self._second()), state)
        discard(rows)

    def _places(self, graph: str) -> dict[str, int]:
        return {c: i for i, c in enumerate([*self.own, *self.names] if graph else self.own)}

    def _start(self):
        models, own, graphs, names, quantiles = self.models, self.own, self.graphs, self.names, self.quantiles
        places = {g: self._places(g) for g in models}

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            grouped: dict = {}
            for usual, bin_, b in zip(pdf["usual"], pdf["bin"], pdf["moments"], strict=True):
                cell = gr.Cell.from_bytes(b, len(own) + 1, len(graphs), len(names))
                grouped[bool(usual), int(bin_)] = grouped[bool(usual), int(bin_)] + cell if (bool(usual), int(bin_)) in grouped else cell
            fits, seconds = [], {}
            for part, cell in gr.parts_of(grouped, quantiles).items():
                for graph, its in models.items():
                    together: dict[tuple, list[Logit]] = {}
                    for m in its:
                        if part == ("usual" if m.clean else "all") or (m.regime is not None and part.startswith(f"{m.regime:g}/")):
                            together.setdefault((m.own if m.net else tuple(m.columns), m.learned), []).append(m)
                    if not together:
                        continue
                    g = cell.gram(graphs.index(graph) if graph else None)
                    for (columns, _), ms in together.items():
                        fits.append(Fits(graph, ms, Design(g, ms[0], part, places[graph], columns), g.n))
                        for m in ms:
                            if m.net:
                                key = (graph, m.net, part)
                                if key not in seconds:
                                    at = [places[graph][c] for c in m.net]
                                    seconds[key] = (Design(g, Logit("", "", m.net), part, places[graph], m.net), g.g[np.ix_(at, at)])
            return pd.DataFrame({"series": pdf["series"].iloc[:1], "fold": pdf["fold"].iloc[:1], "state": [pickle.dumps((fits, seconds))], "left": [sum(int((~f.done).sum()) for f in fits)]})

        return run

    def _values(self):
        """Of a packed block: usual, bin, label and the columns by graph."""
        width, graphs, f = len(self.own), self.graphs, len(self.names)

        def of(n: int, b: bytes):
            m = np.frombuffer(b, "<f8").reshape(n, -1)
            own, net = m[:, 3 : 3 + width], m[:, 4 + width :].reshape(n, len(graphs), f) if graphs else None
            return m[:, 0] > 0, m[:, 1], m[:, 2], lambda graph: np.hstack((own, net[:, graphs.index(graph)])) if graph else own

        return of

    def _sums(self, kind: str):
        """Per task, and series and fold: the sums over its blocks' rows that a Newton step, or the second
        stage, is made of."""
        values, quantiles = self._values(), self.quantiles

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for b in batches:
                for series, fold, n, v, state in zip(b["series"], b["fold"], b["n"], b["v"], b["state"], strict=True):
                    fits, seconds = pickle.loads(state)
                    usual, bin_, y, columns = values(n, v)
                    made: list[list] = []
                    for fit in fits:
                        if kind == "step" and fit.done.all():
                            made.append([])
                            continue
                        keep = fit.design.rows(usual, bin_, quantiles)
                        x, own = fit.design.of(columns(fit.graph)[keep]), y[keep]
                        if kind == "step":
                            made.append(fit.sums(x, own))
                            continue
                        left = []
                        for i, m in enumerate(fit.models):
                            if m.net and fit.fitted:
                                rest = own - sigmoid(x @ fit.beta[i])
                                left.append(seconds[fit.graph, m.net, fit.design.part][0].of(columns(fit.graph)[keep]).T @ rest)
                            else:
                                left.append(np.zeros(1))
                        made.append(left)
                    key = (series, fold)
                    total[key] = [_add(a, c) for a, c in zip(total[key], made, strict=True)] if key in total else made
            if total:
                yield pd.DataFrame({"series": [k[0] for k in total], "fold": [k[1] for k in total], "sums": [pickle.dumps(v) for v in total.values()]})

        return run

    def _merged(self, rows: DataFrame, state: DataFrame, sums, then) -> DataFrame:
        keys = ["series", "fold"]
        parts = rows.join(state.drop("left"), keys).mapInPandas(sums, "series string, fold int, sums binary")
        return parts.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(then, "series string, fold int, state binary, left int")

    def _update(self):
        def run(key, parts: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            fits, seconds = pickle.loads(state["state"].iloc[0])
            total = None
            for b in parts["sums"]:
                one = pickle.loads(b)
                total = one if total is None else [_add(x, y) for x, y in zip(total, one, strict=True)]
            for fit, own in zip(fits, total or [], strict=False):
                if own:
                    fit.step(*own)
            return pd.DataFrame({"series": [key[0]], "fold": [key[1]], "state": [pickle.dumps((fits, seconds))], "left": [sum(int((~f.done).sum()) for f in fits)]})

        return run

    def _second(self):
        def run(key, parts: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            fits, seconds = pickle.loads(state["state"].iloc[0])
            total = None
            for b in parts["sums"]:
                one = pickle.loads(b)
                total = one if total is None else [_add(x, y) for x, y in zip(total, one, strict=True)]
            for fit, own in zip(fits, total or [], strict=False):
                for i, m in enumerate(fit.models):
                    if m.net and fit.fitted:
                        design, cross = seconds[fit.graph, m.net, fit.design.part]
                        a = cross / np.outer(design.sd, design.sd)
                        w = np.linalg.solve(a + m.stage2 * np.eye(len(design.sd)), own[i][1:])
                        fit.second[i] = (design, w, own[i][0] / fit.n)
            return pd.DataFrame({"series": [key[0]], "fold": [key[1]], "state": [pickle.dumps((fits, {}))], "left": [0]})

        return run

    def predictions(self) -> DataFrame:
        """series, dt, category, model, fold, y_true, label, pred, proba of every test row and model. A
        model whose training rows are of one class has no rows; a regime with fewer than `least` rows or
        one class counts with all rows' model."""
        values, quantiles, least = self._values(), self.quantiles, self.least

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for series, fold, n, v, dt, truth, state in zip(b["series"], b["fold"], b["n"], b["v"], b["dt"], b["y"], b["state"], strict=True):
                    usual, bin_, label, columns = values(n, v)
                    odds: dict[tuple[str, str], dict[str, np.ndarray]] = {}
                    of: dict[tuple[str, str], Logit] = {}
                    for fit in pickle.loads(state)[0]:
                        if not fit.fitted:
                            continue
                        z = fit.design.of(columns(fit.graph)) @ fit.beta.T
                        for i, m in enumerate(fit.models):
                            own = z[:, i]
                            if i in fit.second:
                                design, w, mean = fit.second[i]
                                own = own + np.clip(design.of(columns(fit.graph))[:, 1:] @ w + mean, -m.bound, m.bound)
                            if fit.design.part in ("all", "usual") or fit.n >= least:
                                odds.setdefault((m.category, m.name), {})[fit.design.part] = own
                                of[m.category, m.name] = m
                    out = []
                    for key, parts in odds.items():
                        m = of[key]
                        whole = parts.get("usual" if m.clean else "all")
                        if whole is None:
                            continue
                        if m.regime is not None:
                            high = bin_ > quantiles.index(m.regime)
                            for r, on in ((0, ~high), (1, high)):
                                whole = np.where(on, parts.get(f"{m.regime:g}/{r}", whole), whole)
                        proba = sigmoid(whole)
                        out.append(pd.DataFrame({"series": series, "dt": list(dt), "category": key[0], "model": key[1], "fold": fold, "y_true": list(truth), "label": label.astype(int), "pred": (proba >= 0.5).astype(int), "proba": proba}))
                    if out:
                        yield pd.concat(out)

        test = self.blocks.where("role = 'test'").select("series", "fold", "n", "v", "dt", "y")
        kinds = "series string, dt date, category string, model string, fold int, y_true double, label int, pred int, proba double"
        return test.join(self.state.drop("left"), ["series", "fold"]).mapInPandas(run, kinds)

    def parameters(self) -> DataFrame:
        """series, fold, category, model, part, kind, name, value, as of `graphs.Evaluation.parameters`."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for series, fold, state in zip(b["series"], b["fold"], b["state"], strict=True):
                    out = []
                    for fit in pickle.loads(state)[0]:
                        if not fit.fitted:
                            continue
                        for i, m in enumerate(fit.models):
                            rows = [("intercept", "", fit.beta[i, 0])]
                            rows += [(kind, c, v) for kind, values in (("coef", fit.beta[i, 1:]), ("mean", fit.design.mean), ("scale", fit.design.sd)) for c, v in zip(fit.design.names, values, strict=True)]
                            if fit.design.weights is not None:
                                rows += [("projection", f"{r}/{c}", v) for r, w in enumerate(fit.design.weights) for c, v in enumerate(w)]
                            if i in fit.second:
                                design, w, mean = fit.second[i]
                                rows += [("intercept2", "", mean)] + [(kind, c, v) for kind, values in (("coef2", w), ("mean2", design.mean), ("scale2", design.sd)) for c, v in zip(design.names, values, strict=True)]
                            out += [(series, fold, m.category, m.name, fit.design.part, *r) for r in rows]
                    if out:
                        yield pd.DataFrame(out, columns=["series", "fold", "category", "model", "part", "kind", "name", "value"])

        out = self.state.mapInPandas(run, "series string, fold int, category string, model string, part string, kind string, name string, value double")
        cuts = {(m.category, m.name): m.regime for its in self.models.values() for m in its if m.regime is not None}
        return out.unionByName(gr.regime_thresholds(out, self.limits, cuts, self.quantiles))


def _labelled(rows: DataFrame, train: DataFrame, limits: DataFrame, quantile: float, lookback: int | None) -> DataFrame:
    """The rows with `usual`, `bin`, and a label by the threshold of the fold's training rows, or of the
    last `lookback` of them."""
    seen = train
    if lookback:
        last = Window.partitionBy("series", "fold").orderBy(F.desc("dt"))
        seen = train.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= lookback)
    limit = quantiles(seen, ["series", "fold"], "Y_fwd", [quantile]).select("series", "fold", F.col("q")[0].alias("threshold"))
    marked = fc.marked(train).unionByName(rows.where("role = 'test'").withColumn("usual", F.lit(True)))
    marked = marked.join(limit, ["series", "fold"]).join(limits, ["series", "fold"])
    above = F.aggregate("limits", F.lit(0), lambda n, x: n + (F.col("log_RV22") > x).cast("int"))
    return marked.withColumn("label", (F.col("Y_fwd") > F.col("threshold")).cast("int")).withColumn("bin", above)
