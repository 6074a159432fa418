"""The catalogue of linear models, and each model as small solves on one cross-product matrix.

A solved model is a vector over all candidate columns, so predictions of many models are one product.
`graphs` fits the catalogue for all series, folds and graphs at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltide.functions.features import folds
from voltide.operators.models import Gram, solve_all
from voltide.operators.network import VALUES
from voltide.operators.quantiles import quantiles as exact

# The column sets that the models are defined by.
MARKET = ["Market_Returns", "log_Market_RV5", "log_Market_RV22"]
HAR = ["log_RV1", "log_RV5", "log_RV22"]
EXTENDED = ["log_RV1", "log_RV5", "log_RV10", "log_RV22", "log_neg_semi5", "log_pos_semi5"]
STRUCTURE = ["net_degree", "net_degree_change"]
CLUSTERING = ["net_node_clustering", "net_global_clustering", "net_avg_abs_corr"]
OUTLIER_COLUMNS = ["log_RV1", "log_RV5", "log_RV22", "log_Y"]
ALPHAS = (0.2, 0.1, 0.05, 0.01)
RIDGES = ("0.01", "0.10", "1.0")  # as the models' names have them


def unique(columns: list[str]) -> list[str]:
    return list(dict.fromkeys(columns))


def har_features(extended: bool = False, market: bool = True, returns: bool = False) -> list[str]:
    return (EXTENDED if extended else HAR) + (["Returns"] if returns else []) + (MARKET if market else [])


def net_features(clustering: bool = False, split: bool = False) -> list[str]:
    means = [f"net_idw{s}_{c}" for c in VALUES for s in (("_pos", "_neg") if split else ("",))]
    return STRUCTURE + means + (CLUSTERING if clustering else [])


@dataclass(frozen=True)
class Model:
    """One entry of the catalogue. `own` are its columns (of the first stage, if it has a second);
    `net` those of the second stage, solved against the first one's residuals with `stage2` as ridge
    and cut at +-`bound`; with `learned` the rank features of `k` neighbours are projected on their
    `learned` first right singular vectors; `regime` splits the rows at that quantile of log_RV22."""

    category: str
    name: str
    own: tuple[str, ...]
    ridge: float = 0.0
    lasso: float = 0.0
    net: tuple[str, ...] = ()
    stage2: float = 0.0
    bound: float | None = None
    learned: int = 0
    k: int = 0
    regime: float | None = None
    clean: bool = False
    tags: dict = field(default_factory=dict, compare=False)

    @property
    def columns(self) -> list[str]:
        ranks = [f"net_nn{r}_{c}" for r in range(self.k) for c in VALUES] if self.learned else []
        return unique([*self.own, *self.net, *ranks])


def with_clean_twins(models: list[Model]) -> list[Model]:
    """Each model, and where it trains on all rows a twin that trains without outliers."""
    return [m for own in models for m in ([own] if own.clean else [own, replace(own, name=f"{own.name} (no outliers)", clean=True)])]


def baselines(market: bool = True) -> list[Model]:
    har, ext = tuple(har_features(market=market)), tuple(har_features(True, market))
    out = [m for name, own in (("HAR", har), ("HAR-Extended", ext)) for m in with_clean_twins([Model("HAR", name, own)])]
    out += [Model("HAR", f"{name} (a={a:g})", own, lasso=a) for name, own in (("HAR-Lasso", har), ("HAR-Ext-Lasso", ext)) for a in (0.01, 0.1)]
    out += [Model("RegimeSwitching", f"RegHAR (p{100 * q:.0f})", har, regime=q) for q in (0.5, 0.75, 0.9)]
    out += [Model("RegimeSwitching", f"RegHAR-Lasso (p{100 * q:.0f})", har, lasso=0.01, regime=q) for q in (0.5, 0.75)]
    return out


def network_models(category: str, clustering: bool = False, split: bool = False, market: bool = True) -> list[Model]:
    end = {(0, 0): "", (1, 0): "+C", (0, 1): "-Split", (1, 1): "+CSplit"}[clustering, split]
    har, net = tuple(har_features(True, market, True)), tuple(net_features(clustering, split))
    one = [Model(category, f"NetHAR{end} (Lasso a={'0.1' if split and clustering and a == 0.1 else format(a, '.2f')})", har + net, lasso=a) for a in ALPHAS]
    one += [Model(category, f"NetHAR{end} (OLS)", har + net)]
    one += [Model(category, f"NetHAR{end} (Ridge a={a})", har + net, ridge=float(a)) for a in RIDGES]
    pairs = [(0.0, 0.5), (0.0, 1.0), (0.0, None), (0.1, 0.5), (0.5, 0.5), (0.1, 1.0), (0.1, None)]
    if split:
        pairs = [(a, b) for a, b in pairs if (a, b) not in ((0.0, 1.0), (0.5, 0.5))]
    apart = "," if split and clustering else ", "
    two = [Model(category, f"NetworkVAR{end} (a={a}{apart}b={b})", har, net=net, stage2=a, bound=b) for a, b in pairs]
    return with_clean_twins(one + two)


def learned_models(category: str, k: int, clustering: bool = False, market: bool = True) -> list[Model]:
    own = tuple(unique(har_features(True, market, True) + STRUCTURE + (CLUSTERING if clustering else [])))
    end = "+C" if clustering else ""
    out = []
    for m in range(1, k):
        out += [Model(category, f"LearnedW{end} (m={m}, Ridge a={a})", own, ridge=a, learned=m, k=k) for a in (0.01, 1.0, 0.1)]
        out += [Model(category, f"LearnedW{end} (m={m}, Lasso a={a:g})", own, lasso=a, learned=m, k=k) for a in (0.01, 0.05)]
    return with_clean_twins(out)


def catalogue(spark: SparkSession, models: list[Model]) -> DataFrame:
    """category, model, columns, drop_outliers and the parameters, a row for each model."""
    rows = [(m.category, m.name, m.columns, m.clean, {k: float(v) for k, v in (("ridge", m.ridge), ("lasso", m.lasso), ("stage2", m.stage2), ("learned", m.learned)) if v} | ({"bound": m.bound} if m.bound else {}) | ({"regime": m.regime} if m.regime else {})) for m in models]
    return spark.createDataFrame(rows, "category string, model string, columns array<string>, drop_outliers boolean, params map<string,double>")


def task_grid(panel: DataFrame, models: DataFrame, n_splits: int, test: int, min_train: int) -> DataFrame:
    """series, fold, category, model: every fit of an evaluation. A product of tables that are both
    small beside the panel: series and folds, and the catalogue."""
    own = folds(panel, n_splits, test, min_train).select("series", "fold").distinct()
    return own.crossJoin(F.broadcast(models.select("category", "model")))


def fill_net(df: DataFrame) -> DataFrame:
    """Missing network features count as 0: there is no graph yet."""
    return df.fillna(0.0, subset=[c for c in df.columns if c.startswith("net_")])


def needed(columns: list[str]) -> list[str]:
    """What a row must have: all but the network's columns, which are filled."""
    return unique([c for c in columns if not c.startswith("net_")] + ["log_Y", "log_RV22"])


def marked(rows: DataFrame, limit: float = 3.0) -> DataFrame:
    """Training rows with `usual`: no outlier column is `limit` deviations or more from its mean."""
    w = Window.partitionBy("series", "fold")
    usual = F.lit(True)
    for c in OUTLIER_COLUMNS:
        sd = F.stddev_samp(c).over(w)
        usual = usual & F.coalesce(F.when(sd == 0, True).otherwise(F.abs(F.col(c) - F.avg(c).over(w)) < limit * sd), F.lit(False))
    return rows.withColumn("usual", usual)


def thresholds(train: DataFrame, quantiles: list[float], column: str = "log_RV22") -> DataFrame:
    """series, fold and an array of the column's exact quantiles over the training rows."""
    return exact(train, ["series", "fold"], column, quantiles).withColumnRenamed("q", "limits")


class Plan:
    """The regressions that a model is made of on one set of cross products: `first`, those that need no
    other, and `then`, those against the residuals of the first."""

    def __init__(self, g: Gram, m: Model, place: dict[str, int]):
        self.g, self.m = g, m
        self.p = len(place)
        self.own = np.array([place[c] for c in (m.own if m.net else m.columns)])
        self.net = np.array([place[c] for c in m.net], int)
        self.weights = learned_weights(g, m, place) if m.learned else None
        turn = _turn(m, self.weights) if m.learned else None
        self.first = [g.problem(self.own, turn=turn) if m.net else g.problem(self.own, ridge=m.ridge, lasso=m.lasso, turn=turn)]
        self.second: list = []

    def then(self) -> list:
        if self.m.net:
            left = self.g.g[self.net, -1] - self.g.g[np.ix_(self.net, self.own)] @ self.first[0].coef
            self.second = [self.g.problem(self.net, left, ridge=self.m.stage2)]
        return self.second

    def result(self) -> tuple[int, np.ndarray, float, np.ndarray, float]:
        """n, coefficients and intercept over all columns, and those of the second stage."""
        coef, second = np.zeros(self.p), np.zeros(self.p)
        coef[self.own] = self.first[0].coef
        if self.second:
            second[self.net] = self.second[0].coef
        mean = self.g.mean
        return self.g.n, coef, float(mean[-1] - coef @ mean[:-1]), second, float(-second @ mean[:-1])


    def parameters(self) -> list[tuple[str, str, float]]:
        """kind, name, value of all that is learned: means and scales of the columns, coefficients of the
        scaled ones, zeros among them, intercepts, those of the second stage, and the projection."""
        m, mean = self.m, self.g.mean
        names = [*m.own] if m.net else [*m.columns] if not m.learned else [*m.own, *(f"z{i}_{c}" for c in VALUES for i in range(m.learned))]
        out = [("intercept", "", float(mean[-1]))]
        stages = [("", names, self.first[0], self.own)] + [("2", [*m.net], s, self.net) for s in self.second]
        for end, own, s, at in stages:
            middle = mean[at] if s.turn is None else s.turn @ mean[at]
            out += [(f"{kind}{end}", c, float(v)) for kind, values in (("mean", middle), ("scale", s.sd), ("coef", s.beta)) for c, v in zip(own, values, strict=True)]
        if self.weights is not None:
            out += [("projection", f"{r}/{c}", float(v)) for r, w in enumerate(self.weights) for c, v in enumerate(w)]
        return out


def learned_weights(g: Gram, m: Model, place: dict[str, int]) -> np.ndarray:
    """The first right singular vectors of the neighbours' values, all columns stacked."""
    rank = np.array([[place[f"net_nn{r}_{c}"] for r in range(m.k)] for c in VALUES])
    middle = g.mean[rank].mean(0)
    second_moment = sum(g.g[np.ix_(r, r)] + g.n * np.outer(g.mean[r] - middle, g.mean[r] - middle) for r in rank)
    return np.linalg.eigh(second_moment)[1][:, ::-1][:, : m.learned].T


def _turn(m: Model, weights: np.ndarray) -> np.ndarray:
    """The linear combinations of the model's columns that it is solved on."""
    turn = np.zeros((len(m.own) + len(VALUES) * m.learned, len(m.columns)))
    where = {c: i for i, c in enumerate(m.columns)}
    for i, c in enumerate(m.own):
        turn[i, where[c]] = 1
    for f, c in enumerate(VALUES):
        for r in range(m.k):
            turn[len(m.own) + f * m.learned : len(m.own) + (f + 1) * m.learned, where[f"net_nn{r}_{c}"]] = weights[:, r]
    return turn


def _vectors(g: Gram, m: Model, place: dict[str, int]) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Coefficients and intercept of a model over all columns, and those of its second stage."""
    plan = Plan(g, m, place)
    solve_all(plan.first)
    solve_all(plan.then())
    return plan.result()[1:]


def merge_predictions(*stores: DataFrame) -> DataFrame:
    """Prediction stores, wide by date, side by side: all dates of any, y_true from the first that has it."""
    out = stores[0]
    for i, other in enumerate(stores[1:]):
        out = out.join(other.withColumnRenamed("y_true", f"_y{i}"), ["series", "dt"], "full").withColumn("y_true", F.coalesce("y_true", f"_y{i}")).drop(f"_y{i}")
    return out
