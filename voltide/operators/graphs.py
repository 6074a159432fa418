"""Evaluation of the whole catalogue over all graphs at once.

A graph is a distance (and kernel) and a number of neighbours k. One ranked table of neighbours serves
all k: an edge has the smallest k whose graph holds it, and every feature is computed for all graphs in
one pass with the graph as a further key. The features of a date, graph by graph, are one array beside
a series' own columns.

The training rows of a (series, fold) fall into disjoint cells, usual or not by interval of the
regimes' quantiles, and each cell becomes one set of cross products: those of the own columns and the
target once, and for each graph those of its columns with the own ones and with one another. All parts
that models train on are sums of cells. Products of columns of different graphs are never taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions.features import folds
from voltide.operators import forecasting as fc
from voltide.operators import network
from voltide.operators.models import Gram, solve_all
from voltide.operators.network import VALUES
from voltide.sources.store import written

# The distances, kernels and numbers of neighbours of the catalogue, and the names of
# its categories by distance.
KINDS = ("sqcorr", "pcorr", "exp", "mi")
MOST = 5
CATEGORIES = {
    "network": {"sqcorr": "Network", "pcorr": "PCorr Network", "exp": "ExpKernel", "mi": "MI Network"},
    "clustering": {"sqcorr": "Clustering", "exp": "Exp+Clustering"},
    "split": {"sqcorr": "SplitFeatures", "pcorr": "PCorr Split", "exp": "ExpKernel Split", "mi": "MI Split"},
    "both": {"sqcorr": "Split+Clustering"},
    "learned": {"sqcorr": "LearnedWeight", "pcorr": "PCorr LearnedWeight", "mi": "MI LearnedWeight"},
    "learned+": {"sqcorr": "LW+Clustering", "pcorr": "PCorr LW+Clustering", "mi": "MI LW+Clustering"},
}
BY = ("kind", "k")
OWN = [*fc.EXTENDED, "Returns", *fc.MARKET]


def graph_id(kind: str, k: int) -> str:
    return f"{kind}/{k}"


def net_names(most: int = MOST) -> list[str]:
    """The columns of one graph, in the order of its part of the array."""
    return [c for c in network.feature_names(VALUES, most) if not c.endswith("_dist")]


def distances(panel: DataFrame, kinds: tuple[str, ...] = KINDS, window: int = 60, step: int = 5, bins: int = 10, shrinkage: float = 0.1) -> DataFrame:
    """kind, snapshot, s1 < s2, d, rho: the pairs by every distance; rho is the plain correlation, by
    whose sign neighbours are split whatever the distance. `exp` has the distances of `sqcorr`."""
    rho = written(network.squared_distance(network.correlations(panel, window, step)))
    keys = ["snapshot", "s1", "s2"]
    out = None
    held = written(network.windows(panel, window, step)) if {"pcorr", "mi"} & {*kinds} else None
    for kind in kinds:
        if kind in ("sqcorr", "exp"):
            own = rho.select(*keys, "d", "rho")
        else:
            found = network.precision_partial(held, shrinkage) if kind == "pcorr" else network.mutual_information(held, bins)
            own = found.select(*keys, "d").join(rho.select(*keys, "rho"), keys)
        own = own.select(F.lit(kind).alias("kind"), *keys, "d", "rho")
        out = own if out is None else out.unionByName(own)
    return out


def levelled(pairs: DataFrame, most: int = MOST, digits: int = 9) -> DataFrame:
    """kind, snapshot, src, dst, d, rho, level: directed rows of the edges of the graph of the `most`
    nearest neighbours; an edge is in the graph of k neighbours if its level is k or less."""
    keys = ["kind", "snapshot"]
    both = pairs.select(*keys, F.col("s1").alias("src"), F.col("s2").alias("dst"), "d", "rho").unionByName(pairs.select(*keys, F.col("s2").alias("src"), F.col("s1").alias("dst"), "d", "rho"))
    w = network.Window.partitionBy(*keys, "src").orderBy(F.round("d", digits), "dst")
    near = both.withColumn("level", F.row_number().over(w)).where(F.col("level") <= most)
    back = near.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "d", "rho", "level")
    return near.unionByName(back).groupBy(*keys, "src", "dst").agg(F.min("d").alias("d"), F.min("rho").alias("rho"), F.min("level").alias("level"))


def all_edges(levels: DataFrame, pairs: DataFrame, ks: tuple[int, ...], stride: int = 1) -> DataFrame:
    """kind, k, snapshot, src, dst, d, rho of every graph; rho of the latest saved snapshot."""
    if stride > 1:
        rho = pairs.select("snapshot", "s1", "s2", "rho").dropDuplicates(["snapshot", "s1", "s2"])
        saved = network.with_saved_signs(levels.select("snapshot", "src", "dst", F.lit(0.0).alias("d")).distinct(), rho, stride).drop("d")
        levels = levels.drop("rho").join(saved, ["snapshot", "src", "dst"])
    held = F.explode(F.array_compact(F.array(*(F.when(F.col("level") <= k, k) for k in ks))))
    return levels.select("kind", held.alias("k"), "snapshot", "src", "dst", "d", "rho")


def all_features(pairs: DataFrame, edges: DataFrame, values: DataFrame, ks: tuple[int, ...], step: int, most: int = MOST) -> DataFrame:
    """kind, k, snapshot, src and `net_names`: the features of the nodes of every graph. `pairs` and
    `edges` are written tables."""
    keys = [*BY, "snapshot", "src"]
    known = network.carried(values.select("series", "i", *VALUES), ["series"], "i", VALUES)
    everyone = network.nodes(pairs, ("kind",)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    local = network.clustering(edges, everyone, BY)
    out = network.turnover(edges, everyone, step, BY).withColumnsRenamed({"degree": "net_degree", "turnover": "net_degree_change"})
    out = out.join(local.withColumnRenamed("clustering", "net_node_clustering"), keys, "left")
    out = out.join(network.global_clustering(local, BY).withColumnRenamed("clustering", "net_global_clustering"), [*BY, "snapshot"], "left")
    out = out.join(pairs.groupBy("kind", "snapshot").agg(F.avg(F.abs("rho")).alias("net_avg_abs_corr")), ["kind", "snapshot"], "left")
    weight = F.when(F.col("kind") == "exp", F.exp(-5.0 * F.col("d"))).otherwise(1 / F.greatest("d", F.lit(1e-8)))
    out = out.join(network.neighbour_features(edges, known, VALUES, weight, by=BY), keys, "left")
    return out.join(network.rank_features(edges, known, VALUES, most, BY), keys, "left").select(*keys, *net_names(most))


def packed(features: DataFrame, panel: DataFrame, graphs: list[tuple[str, int]], step: int, most: int = MOST) -> DataFrame:
    """series, snapshot, net: on every `step`-th date the last known features of every graph, in the
    order of `graphs`, as one array; 0 where none is known yet."""
    names = net_names(most)
    place = F.element_at(F.create_map(*(F.lit(x) for n, (kind, k) in enumerate(graphs) for x in (graph_id(kind, k), n))), F.concat_ws("/", "kind", "k"))
    own = features.select(place.alias("g"), "snapshot", F.col("src").alias("series"), *names).where("g is not null")
    dates = panel.where(F.col("i") % step == 0).select("series", F.col("i").alias("snapshot"), F.explode(F.array(*(F.lit(n) for n in range(len(graphs))))).alias("g"))
    known = network.carried(dates.join(own, ["series", "snapshot", "g"], "left"), ["series", "g"], "snapshot", names)
    part = F.struct("g", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names)).alias("v"))
    return known.groupBy("series", "snapshot").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["v"])).alias("net"))


def catalogue(graphs: list[tuple[str, int]], market: bool = True) -> dict[str, list[fc.Model]]:
    """The linear models by graph; those without a graph under the empty name."""
    out: dict[str, list[fc.Model]] = {"": fc.baselines(market)}
    for kind, k in graphs:
        own = out.setdefault(graph_id(kind, k), [])
        for part, names in CATEGORIES.items():
            if kind in names:
                category = f"{names[kind]} [k={k}]"
                if part.startswith("learned"):
                    own += fc.learned_models(category, k, clustering=part == "learned+", market=market)
                else:
                    own += fc.network_models(category, clustering=part in ("clustering", "both"), split=part in ("split", "both"), market=market)
    return out


def joined(panel: DataFrame, nets: DataFrame, n_splits: int, test: int, min_train: int, step: int, own: list[str] = OWN) -> DataFrame:
    """series, fold, i, dt, role, Y_fwd, log_RV22, x (own columns and log_Y) and net of the complete rows of
    every fold. The array of a date is that of the last `step`-th date up to it."""
    rows = folds(panel.dropna(subset=fc.unique([*own, "log_RV22", "log_Y"])), n_splits, test, min_train)
    last = (F.col("i") - F.col("i") % step).cast(dict(nets.dtypes)["snapshot"])
    rows = rows.withColumn("snapshot", last).join(nets, ["series", "snapshot"], "left")
    return rows.select("series", "fold", "i", "dt", "role", *fc.OUTLIER_COLUMNS, "Y_fwd", F.array(*(F.col(c).cast("double") for c in [*own, "log_Y"])).alias("x"), "net")


class Cell:
    """n, means and centred cross products: `oo` of the own columns and the target, `on` of these with
    each graph's, `nn` of each graph's with one another. Two disjoint cells add up."""

    def __init__(self, n, mo, mn, oo, on, nn):
        self.n, self.mo, self.mn, self.oo, self.on, self.nn = n, mo, mn, oo, on, nn

    @classmethod
    def of(cls, x: np.ndarray, net: np.ndarray) -> Cell:
        mo, mn = x.mean(0), net.mean(0)
        x, net = x - mo, (net - mn).transpose(1, 0, 2)
        return cls(len(x), mo, mn, x.T @ x, x.T[None] @ net, net.transpose(0, 2, 1) @ net)

    def __add__(self, b: Cell) -> Cell:
        n = self.n + b.n
        do, dn, w = b.mo - self.mo, b.mn - self.mn, self.n * b.n / n
        return Cell(n, self.mo + do * (b.n / n), self.mn + dn * (b.n / n), self.oo + b.oo + w * np.outer(do, do), self.on + b.on + w * do[None, :, None] * dn[:, None, :], self.nn + b.nn + w * dn[:, :, None] * dn[:, None, :])

    def to_bytes(self) -> bytes:
        return np.concatenate([np.ravel(v) for v in (self.n, self.mo, self.mn, self.oo, self.on, self.nn)]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes, p: int, g: int, f: int) -> Cell:
        v, out, at = np.frombuffer(b, "<f8"), [], 0
        for shape in ((), (p,), (g, f), (p, p), (g, p, f), (g, f, f)):
            size = int(np.prod(shape))
            out.append(v[at : at + size].reshape(shape))
            at += size
        return cls(int(out[0]), *out[1:])

    def gram(self, g: int | None) -> Gram:
        """The cross products of the own columns, graph g's and the target, the target last."""
        p = len(self.mo) - 1
        if g is None:
            return Gram.whole(self.n, self.mo, self.oo)
        order = [*range(p), *range(p + 1, p + 1 + self.nn.shape[1]), p]
        full = np.block([[self.oo, self.on[g]], [self.on[g].T, self.nn[g]]])[np.ix_(order, order)]
        return Gram.whole(self.n, np.concatenate((self.mo, self.mn[g]))[order], full)


def cells(train: DataFrame, limits: DataFrame, p: int, g: int, f: int, most_keys: int = 2_000) -> DataFrame:
    """series, fold, usual, bin, moments: one row a task and cell. A row's bin is the number of quantiles
    that its log_RV22 is beyond."""
    rows = fc.marked(train).join(limits, ["series", "fold"])
    above = F.aggregate("limits", F.lit(0), lambda n, x: n + (F.col("log_RV22") > x).cast("int"))
    rows = rows.select("series", "fold", "usual", above.alias("bin"), "x", "net")
    keys = ["series", "fold", "usual", "bin"]

    def frame(parts: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(parts), columns=keys)
        out["moments"] = [c.to_bytes() for c in parts.values()]
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict = {}
        for b in batches:
            for key, own in b.groupby(keys, sort=False):
                net = np.stack(own["net"]).reshape(len(own), g, f) if g else np.zeros((len(own), 0, f))
                cell = Cell.of(np.stack(own["x"]), net)
                parts[key] = parts[key] + cell if key in parts else cell
            if len(parts) > most_keys:
                yield frame(parts)
                parts = {}
        if parts:
            yield frame(parts)

    return rows.mapInPandas(partial, "series string, fold int, usual boolean, bin int, moments binary")


def parts_of(found: dict[tuple[bool, int], Cell], quantiles: list[float]) -> dict[str, Cell]:
    """The parts that models train on, as sums of disjoint cells."""
    out: dict[str, Cell] = {}
    for (usual, bin_), cell in sorted(found.items()):
        names = ["all"] + ["usual"] * usual + [f"{q:g}/{int(bin_ > i)}" for i, q in enumerate(quantiles)]
        for name in names:
            out[name] = out[name] + cell if name in out else cell
    return out


FITTED = "series string, fold int, graph string, category string, model string, part string, n long, coef array<double>, intercept double, second array<double>, offset double"
#: What is learned, if it is asked for.
PARAMS = "array<struct<kind:string,name:string,value:double>>"


def fit(found: DataFrame, models: dict[str, list[fc.Model]], graphs: list[str], own: list[str], names: list[str], quantiles: list[float], params: bool = False) -> DataFrame:
    """Every model solved on the parts that it uses. `coef` and `second` are over the own columns and,
    for a model of a graph, that graph's. A group holds the cells of one series and fold, a row for each
    cell and task that had rows of it; solves of one size are done together."""
    p, g, f = len(own) + 1, len(graphs), len(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grouped: dict[tuple[bool, int], Cell] = {}
        for usual, bin_, b in zip(pdf["usual"], pdf["bin"], pdf["moments"], strict=True):
            cell = Cell.from_bytes(b, p, g, f)
            key = (bool(usual), int(bin_))
            grouped[key] = grouped[key] + cell if key in grouped else cell
        parts = parts_of(grouped, quantiles)
        jobs = []  # a model on a part, with its problems
        for graph, its in models.items():
            at = graphs.index(graph) if graph else None
            columns = [*own, *names] if graph else own
            place = {c: i for i, c in enumerate(columns)}
            for part, cell in parts.items():
                wanted = [m for m in its if part == ("usual" if m.clean else "all") or (m.regime is not None and part.startswith(f"{m.regime:g}/"))]
                gram = cell.gram(at) if wanted else None
                jobs += [(graph, m, part, fc.Plan(gram, m, place)) for m in wanted]
        solve_all([s for *_, plan in jobs for s in plan.first])
        solve_all([s for *_, plan in jobs for s in plan.then()])
        key = pdf["series"].iloc[0], int(pdf["fold"].iloc[0])
        rows = pd.DataFrame([(*key, graph, m.category, m.name, part, *plan.result()) for graph, m, part, plan in jobs], columns=[x.split()[0] for x in FITTED.split(", ")])
        if params:
            rows["params"] = [[dict(zip(("kind", "name", "value"), x, strict=True)) for x in plan.parameters()] for *_, plan in jobs]
        return rows

    return found.groupBy("series", "fold").applyInPandas(run, f"{FITTED}, params {PARAMS}" if params else FITTED)


def predict(test: DataFrame, fitted: DataFrame, limits: DataFrame, models: dict[str, list[fc.Model]], graphs: list[str], own: list[str], names: list[str], quantiles: list[float], least: int = 30, eps: float = 1e-8, predictions: bool = False) -> DataFrame:
    """series, fold, category, model and the sums over test rows that metrics are made of (`metrics`); or,
    with `predictions`, series, dt, category, model, fold, y_true and y_pred of every row. All models of
    a graph are one product. A group holds one series' test block and its models."""
    by = {(m.category, m.name): m for its in models.values() for m in its}
    p, f = len(own), len(names)
    rows = test.join(limits, ["series", "fold"])

    def run(key, block, solved):
        out = []
        if len(block) and len(solved):
            x = np.stack(block["x"])[:, :p]
            net = np.stack(block["net"]).reshape(len(block), -1, f) if graphs else None
            level, limits_ = block["log_RV22"].to_numpy(), block["limits"].iloc[0]
            truth = block["Y_fwd"].to_numpy()
            for graph, own_models in solved.groupby("graph", sort=False):
                z = np.hstack((x, net[:, graphs.index(graph)])) if graph else x
                coef, second = np.stack(own_models["coef"]), np.stack(own_models["second"])
                bound = np.array([np.inf if by[k].bound is None else by[k].bound for k in zip(own_models["category"], own_models["model"], strict=True)])
                extra = z @ second.T + own_models["offset"].to_numpy()
                value = z @ coef.T + own_models["intercept"].to_numpy() + np.clip(extra, -bound, bound)
                index = {k: i for i, k in enumerate(zip(own_models["category"], own_models["model"], own_models["part"], strict=True))}
                n = own_models["n"].to_numpy()
                keys, columns = [], []
                for (category, name, part), i in index.items():
                    m = by[category, name]
                    if part not in ("all", "usual"):
                        continue
                    column = value[:, i]
                    if m.regime is not None:
                        high = level > limits_[quantiles.index(m.regime)]
                        for r, on in ((0, ~high), (1, high)):
                            j = index.get((category, name, f"{m.regime:g}/{r}"))
                            if j is not None and n[j] >= least:
                                column = np.where(on, value[:, j], column)
                    keys.append((category, name))
                    columns.append(column)
                guess = np.exp(np.stack(columns, 1))
                if predictions:
                    out += [pd.DataFrame({"series": key[0], "dt": block["dt"], "category": c, "model": m, "fold": key[1], "y_true": truth, "y_pred": guess[:, i]}) for i, (c, m) in enumerate(keys)]
                    continue
                ly, lp = np.log(np.maximum(truth, eps))[:, None], np.log(np.maximum(guess, eps))
                e, le = truth[:, None] - guess, ly - lp
                sums = {"n": len(truth), "sum": truth.sum(), "squares": (truth**2).sum(), "log_sum": ly.sum(), "log_squares": (ly**2).sum(), "sse": (e**2).sum(0), "sae": np.abs(e).sum(0), "log_sse": (le**2).sum(0), "log_sae": np.abs(le).sum(0)}
                out.append(pd.DataFrame({"series": key[0], "fold": key[1], "category": [c for c, _ in keys], "model": [m for _, m in keys], **sums}))
        return pd.concat(out) if out else pd.DataFrame({x.split()[0]: [] for x in kinds.split(", ")})

    kinds = "series string, fold int, category string, model string, n long, " + ", ".join(f"{c} double" for c in SUMS)
    if predictions:
        kinds = "series string, dt date, category string, model string, fold int, y_true double, y_pred double"
    keys = ["series", "fold"]
    return rows.groupBy(*keys).cogroup(fitted.groupBy(*keys)).applyInPandas(run, kinds)


SUMS = ("sum", "squares", "log_sum", "log_squares", "sse", "sae", "log_sse", "log_sae")


def metrics(sums: DataFrame, keys: list[str]) -> DataFrame:
    """R2, RMSE and MAE, raw and in logs, from the sums of test blocks, added up by the keys."""
    out = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in SUMS))
    made = []
    for own, end in (("", ""), ("log_", "_log")):
        spread = F.col(f"{own}squares") - F.col(f"{own}sum") ** 2 / F.col("n")
        made += [
            (1 - F.try_divide(F.col(f"{own}sse"), spread)).alias(f"R2{end}"),
            F.sqrt(F.col(f"{own}sse") / F.col("n")).alias(f"RMSE{end}"),
            (F.col(f"{own}sae") / F.col("n")).alias(f"MAE{end}"),
        ]
    return out.select(*keys, *made)


class Evaluation:
    """One run: fitted models, sums for metrics, and predictions of chosen models."""

    def __init__(self, panel: DataFrame, nets: DataFrame, models: dict[str, list[fc.Model]], n_splits: int = 1, test: int = 252, min_train: int = 1260, step: int = 5, own: list[str] = OWN, most: int = MOST, params: bool = False):
        """`panel` has series, i, dt, the own columns, log_RV22, log_Y and Y_fwd; `nets` is what `packed`
        gives for the graphs of `models`, in their order."""
        self.models, self.own, self.names = models, own, net_names(most)
        self.graphs = [g for g in models if g]
        self.quantiles = sorted({m.regime for its in models.values() for m in its if m.regime is not None} | {0.5})
        self.rows = written(joined(panel, nets, n_splits, test, min_train, step, own))
        train = self.rows.where("role = 'train'")
        self.limits = written(fc.thresholds(train, self.quantiles))
        found = cells(train, self.limits, len(own) + 1, len(self.graphs), len(self.names))
        self.fitted = written(fit(found, models, self.graphs, own, self.names, self.quantiles, params))

    def _predict(self, models: dict[str, list[fc.Model]], predictions: bool) -> DataFrame:
        kept = {(m.category, m.name) for its in models.values() for m in its}
        own = self.fitted if models is self.models else self.fitted.where(F.struct("category", "model").isin([F.struct(F.lit(c), F.lit(m)) for c, m in sorted(kept)]))
        return predict(self.rows.where("role = 'test'"), own, self.limits, self.models, self.graphs, self.own, self.names, self.quantiles, predictions=predictions)

    def metrics(self, keys: tuple[str, ...] = ("category", "model", "series", "fold")) -> DataFrame:
        return metrics(self._predict(self.models, False), list(keys))

    def predictions(self, models: list[fc.Model]) -> DataFrame:
        return self._predict({"": models}, True)

    def parameters(self) -> DataFrame:
        """series, fold, category, model, part, kind, name, value of a run with `params`; the thresholds
        of regimes are in the part `all`."""
        keys = ["series", "fold", "category", "model", "part"]
        out = self.fitted.select(*keys, F.explode("params").alias("x")).select(*keys, "x.*")
        cuts = {(m.category, m.name): m.regime for its in self.models.values() for m in its if m.regime is not None}
        return out.unionByName(regime_thresholds(out, self.limits, cuts, self.quantiles))


def regime_thresholds(params: DataFrame, limits: DataFrame, cuts: dict[tuple[str, str], float], quantiles: list[float]) -> DataFrame:
    """Parameter rows with the thresholds of the models in `cuts`."""
    place = F.lit(None).cast("int")
    for (category, name), q in cuts.items():
        place = F.when((F.col("category") == category) & (F.col("model") == name), quantiles.index(q) + 1).otherwise(place)
    keys = ["series", "fold", "category", "model"]
    own = params.select(*keys).distinct().withColumn("at", place).where("at is not null").join(limits, ["series", "fold"])
    return own.select(*keys, F.lit("all").alias("part"), F.lit("threshold").alias("kind"), F.lit("log_RV22").alias("name"), F.element_at("limits", F.col("at")).alias("value"))
