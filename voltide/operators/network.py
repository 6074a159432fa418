"""Rolling similarity networks as edge tables, and the features of their nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.sources.store import written


def covered(panel: DataFrame, window: int = 60, step: int = 5, coverage: float = 0.8, least: int = 10) -> DataFrame:
    """snapshot, series: the series with `coverage` of their trailing window at every `step`-th date,
    in snapshots that have `least` of them or more. Counts per block of `step` dates are added up, so
    no row is copied into the snapshots that hold it."""
    if window % step:
        raise ValueError("the window must hold whole steps")
    block = F.floor((F.col("i") - 1) / step).cast("int")
    counts = panel.groupBy("series", block.alias("block")).agg(F.count("Returns").alias("n"), F.max("i").alias("top"))
    top = counts.agg(F.max("top").alias("top"))
    ends = F.explode(F.sequence((F.col("block") + 1) * step, (F.col("block") + window // step) * step, F.lit(step)))
    own = counts.select("series", "n", ends.alias("snapshot")).join(F.broadcast(top)).where((F.col("snapshot") >= window) & (F.col("snapshot") <= F.col("top")))
    own = own.groupBy("snapshot", "series").agg(F.sum("n").alias("n")).where(F.col("n") >= coverage * window).drop("n")
    enough = own.groupBy("snapshot").agg(F.count(F.lit(1)).alias("p")).where(F.col("p") >= least).select("snapshot")
    return own.join(enough, "snapshot", "left_semi")


def windows(panel: DataFrame, window: int = 60, step: int = 5, coverage: float = 0.8, least: int = 10) -> DataFrame:
    """snapshot, series, i, r: the trailing window of every `step`-th date, gaps as zero, for the
    series of `covered`. Membership of a row in snapshots is an explode of the few that hold it, so
    what compares series is an equi-join on (snapshot, i) and needs no range join."""
    first = ((F.floor((F.col("i") - 1) / step) + 1) * step).cast("int")
    rows = panel.select("series", "i", F.coalesce("Returns", F.lit(0.0)).alias("r"), F.explode(F.sequence(first, first + (window - step), F.lit(step))).alias("snapshot"))
    return rows.join(covered(panel, window, step, coverage, least), ["snapshot", "series"]).select("snapshot", "series", "i", "r")


def _moments() -> tuple[list[Column], Column]:
    """The means that a correlation of x and y is made of, and the correlation, null if undefined."""
    means = [F.avg(e).alias(n) for n, e in (("mx", F.col("x")), ("my", F.col("y")), ("xx", F.col("x") ** 2), ("yy", F.col("y") ** 2), ("xy", F.col("x") * F.col("y")))]
    vx, vy = F.col("xx") - F.col("mx") ** 2, F.col("yy") - F.col("my") ** 2
    rho = F.try_divide(F.col("xy") - F.col("mx") * F.col("my"), F.sqrt(vx * vy))
    return means, F.when((vx > 1e-12) & (vy > 1e-12), _clip(rho))


def _clip(rho: Column) -> Column:
    return F.least(F.greatest(rho, F.lit(-1 + 1e-8)), F.lit(1 - 1e-8))


def _undefined(sums: DataFrame, window: int) -> DataFrame:
    """snapshot of the windows in which a series does not vary, from snapshot, series, mx, xx: sums of its
    values and of their squares. One undefined correlation makes all of its snapshot 0."""
    mean = F.col("mx") / window
    return sums.where(F.col("xx") / window - mean**2 <= 1e-12).select("snapshot").distinct()


def _zero(pairs: DataFrame, undefined: DataFrame) -> DataFrame:
    out = pairs.join(undefined.withColumn("_zero", F.lit(True)), "snapshot", "left")
    return out.withColumn("rho", F.when(F.col("_zero"), 0.0).otherwise(F.col("rho"))).drop("_zero")


#: Series of a tile, and blocks of dates of a span: a task multiplies two tiles over one span.
TILE, SPAN = 128, 48


def tiles(rows: DataFrame, by: str, tile: int = TILE) -> DataFrame:
    """The columns `by`, members1 and members2: for every two tiles of series, a tile and itself included,
    the rows of both as arrays of structs. `rows` has one row for each series and `by`. Series are dealt
    to tiles by a hash of their names, so that a task meets some `tile` of them on either side."""
    rows = written(rows)  # counted, and read for both sides
    n = max(1, -(-rows.select("series").distinct().count() // tile))
    members = F.collect_list(F.struct(*(c for c in rows.columns if c != by))).alias("members")
    held = rows.withColumn("tile", F.pmod(F.xxhash64("series"), F.lit(n))).groupBy(by, "tile").agg(members)
    one, two = held.select(by, F.col("tile").alias("t1"), F.col("members").alias("members1")), held.select(by, F.col("tile").alias("t2"), F.col("members").alias("members2"))
    return one.join(two, by).where("t1 <= t2").select(by, (F.col("t1") == F.col("t2")).alias("same"), "members1", "members2")


def _pairs_of(names1: np.ndarray, names2: np.ndarray, same: bool, *held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the pairs of two tiles, after `held` (a mask with further dimensions in front, or none):
    each pair of different series once."""
    mask = np.ones((len(names1), len(names2)), bool) if not same else names1[:, None] < names2[None]
    return np.nonzero(mask if not held else held[0] & mask)


def _named(one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
    first = one < two
    return {"s1": np.where(first, one, two), "s2": np.where(first, two, one)}


def correlations(panel: DataFrame, window: int = 60, step: int = 5, coverage: float = 0.8, least: int = 10, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """snapshot, s1 < s2, rho of the trailing windows; an undefined one makes its snapshot 0.

    Series are dealt to tiles and dates to spans of `span` blocks of `step`. A task holds two tiles over
    one span, with the blocks before it that its first windows reach back to: one matrix product for
    each block, and a snapshot is the sum of its blocks' products. No row stands for a pair and date."""
    back = window // step - 1
    held = covered(panel, window, step, coverage, least)
    block = F.floor((F.col("i") - 1) / step)
    value = F.coalesce("Returns", F.lit(0.0))
    sums = panel.groupBy("series", block.alias("block")).agg(F.sum(value).alias("mx"), F.sum(value * value).alias("xx"))
    w = Window.partitionBy("series").orderBy("block").rangeBetween(-back, 0)
    sums = sums.select("series", ((F.col("block") + 1) * step).cast("int").alias("snapshot"), F.sum("mx").over(w).alias("mx"), F.sum("xx").over(w).alias("xx"))
    undefined = _undefined(sums.join(held, ["snapshot", "series"], "left_semi"), window)

    reach = F.array_distinct(F.array(F.floor(block / span), F.floor((block + back) / span)))
    points = panel.select("series", F.explode(reach).alias("span"), F.struct((F.col("i") - 1).alias("at"), value.alias("v")).alias("p")).groupBy("series", "span").agg(F.collect_list("p").alias("points"))
    last = F.col("snapshot") / step - 1
    on = held.select("series", F.floor(last / span).alias("span"), last.cast("int").alias("b")).groupBy("series", "span").agg(F.collect_list("b").alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, same, one, two in zip(batch["span"], batch["same"], batch["members1"], batch["members2"], strict=True):
                start = (at * span - back) * step
                sides = []
                for members in (one, two):
                    x, use = np.zeros((len(members), (span + back) * step)), np.zeros((span, len(members)), bool)
                    for j, m in enumerate(members):
                        for p in m["points"]:
                            x[j, p["at"] - start] = p["v"]
                        use[[b - at * span for b in m["blocks"]], j] = True
                    x = x.reshape(len(members), span + back, step).transpose(1, 0, 2)
                    rolled = [sum(v[k : k + span] for k in range(back + 1)) / window for v in (x.sum(2), (x**2).sum(2))]
                    sides.append((np.array([m["series"] for m in members], object), x, use, rolled[0], rolled[1] - rolled[0] ** 2))
                (n1, x1, u1, m1, v1), (n2, x2, u2, m2, v2) = sides
                product = x1 @ x2.transpose(0, 2, 1)
                cross = sum(product[k : k + span] for k in range(back + 1)) / window - m1[:, :, None] * m2[:, None]
                spread = v1[:, :, None] * v2[:, None]
                rho = np.clip(cross / np.sqrt(np.where(spread > 0, spread, np.inf)), -1 + 1e-8, 1 - 1e-8)
                k, i, j = _pairs_of(n1, n2, same, u1[:, :, None] & u2[:, None])
                if len(k):
                    yield pd.DataFrame({"snapshot": (at * span + k + 1) * step, **_named(n1[i], n2[j]), "rho": rho[k, i, j]})

    pairs = tiles(points.join(on, ["series", "span"]), "span", tile).mapInPandas(run, "snapshot int, s1 string, s2 string, rho double")
    return _zero(pairs, undefined)


def pair_correlations(held: DataFrame, tile: int = TILE) -> DataFrame:
    """The correlations of windows that are given row by row: one product for two tiles and a snapshot."""
    value = F.struct("i", "r")
    rows = held.groupBy("snapshot", "series").agg(F.transform(F.array_sort(F.collect_list(value)), lambda p: p["r"]).alias("x"))
    sums = held.groupBy("snapshot", "series").agg(F.avg("r").alias("mx"), F.avg(F.col("r") ** 2).alias("xx"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for snapshot, same, one, two in zip(batch["snapshot"], batch["same"], batch["members1"], batch["members2"], strict=True):
                names, scaled = [], []
                for members in (one, two):
                    x = np.array([m["x"] for m in members])
                    mean = x.mean(1)
                    spread = (x**2).mean(1) - mean**2
                    names.append(np.array([m["series"] for m in members], object))
                    scaled.append((x - mean[:, None]) / np.sqrt(np.where(spread > 1e-12, spread, np.inf))[:, None])
                rho = np.clip(scaled[0] @ scaled[1].T / scaled[0].shape[1], -1 + 1e-8, 1 - 1e-8)
                i, j = _pairs_of(*names, same)
                yield pd.DataFrame({"snapshot": snapshot, **_named(names[0][i], names[1][j]), "rho": rho[i, j]})

    pairs = tiles(rows, "snapshot", tile).mapInPandas(run, "snapshot int, s1 string, s2 string, rho double")
    return _zero(pairs, _undefined(sums, 1))


def by_matrix(held: DataFrame, distance: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """snapshot, s1 < s2, rho, d by a function of a snapshot's (dates x series) matrix that gives the
    similarities and the distances as matrices: the extension point for distances that are no sums
    over dates. A task holds one snapshot's window, whose size the calendar and the universe set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="series", values="r").sort_index(axis=1)
        rho, d = distance(m.to_numpy())
        x, y = np.triu_indices(m.shape[1], 1)
        names = m.columns.to_numpy()
        return pd.DataFrame({"snapshot": pdf["snapshot"].iloc[0], "s1": names[x], "s2": names[y], "rho": rho[x, y], "d": d[x, y]})

    return held.groupBy("snapshot").applyInPandas(run, "snapshot int, s1 string, s2 string, rho double, d double")


def safe_correlation(m: np.ndarray) -> np.ndarray:
    """The correlation matrix, or the identity if any of its cells is undefined."""
    x = m - m.mean(0)
    sd = np.sqrt((x**2).mean(0))
    if (sd**2 <= 1e-12).any():
        return np.eye(m.shape[1])
    rho = np.clip((x.T @ x) / len(m) / np.outer(sd, sd), -1 + 1e-8, 1 - 1e-8)
    np.fill_diagonal(rho, 1.0)
    return rho


def precision_distance(shrinkage: float = 0.1) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Partial correlations from the inverse of a correlation matrix that is drawn towards the
    identity, by 0.2 more (at most to a half) with no more dates than series; 1 - their squares."""

    def distance(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, p = m.shape
        a = shrinkage if n > p else min(shrinkage + 0.2, 0.5)
        inverse = np.linalg.inv((1 - a) * safe_correlation(m) + a * np.eye(p))
        scale = np.sqrt(np.clip(np.diag(inverse), 1e-12, None))
        rho = np.clip(-inverse / np.outer(scale, scale), -1 + 1e-8, 1 - 1e-8)
        return rho, 1 - rho**2

    return distance


def precision_partial(held: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    return by_matrix(held, precision_distance(shrinkage))


def market_partial(held: DataFrame) -> DataFrame:
    """snapshot, s1 < s2, rho, d: correlations given the equal-weight mean of all series, in closed
    form, and 1 - rho squared."""
    market = held.groupBy("snapshot", "i").agg(F.avg("r").alias("y"))
    means, rho = _moments()
    own = held.withColumnRenamed("r", "x").join(market, ["snapshot", "i"]).groupBy("snapshot", "series").agg(*means)
    own = own.select("snapshot", "series", rho.alias("rho"))
    own = _zero(own, own.where("rho is null").select("snapshot").distinct())
    out = pair_correlations(held)
    for s, name in (("s1", "m1"), ("s2", "m2")):
        out = out.join(own.select("snapshot", F.col("series").alias(s), F.col("rho").alias(name)), ["snapshot", s])
    free = lambda c: F.greatest(1 - F.col(c) ** 2, F.lit(1e-10))
    value = _clip((F.col("rho") - F.col("m1") * F.col("m2")) / F.sqrt(free("m1") * free("m2")))
    return squared_distance(out.select("snapshot", "s1", "s2", value.alias("rho")))


def rank_bins(held: DataFrame, bins: int = 10) -> DataFrame:
    """snapshot, series, i, bin: equal-frequency bins by rank; tied values have distinct ranks."""
    w = Window.partitionBy("snapshot", "series")
    rank = F.row_number().over(w.orderBy(F.round("r", 9), "i")) - 1
    return held.select("snapshot", "series", "i", F.floor(rank * bins / F.count(F.lit(1)).over(w)).cast("int").alias("bin"))


def entropies(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of the counts `c` per key: ln n - sum(c ln c) / n."""
    n = F.sum("c")
    return cells.groupBy(*keys).agg((F.log(n) - F.sum(F.col("c") * F.log("c")) / n).alias("h"))


def mutual_information(held: DataFrame, bins: int = 10, tile: int = TILE) -> DataFrame:
    """snapshot, s1 < s2, nmi, d = 1 - nmi: mutual information by the geometric mean of entropies.

    A series' bins of a window are one array. For two tiles of series and a snapshot the counts of all
    pairs' cells are one matrix product, of both tiles' rows of ones where a series is in a bin."""
    b = rank_bins(held, bins)
    one = entropies(b.groupBy("snapshot", "series", "bin").agg(F.count(F.lit(1)).alias("c")), ["snapshot", "series"])
    arrays = b.groupBy("snapshot", "series").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bin"))), lambda x: x["bin"]).alias("bins")).join(one, ["snapshot", "series"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for snapshot, same, *sides in zip(batch["snapshot"], batch["same"], batch["members1"], batch["members2"], strict=True):
                names, ones, h = [], [], []
                for members in sides:
                    own = np.array([m["bins"] for m in members])
                    names.append(np.array([m["series"] for m in members], object))
                    h.append(np.array([m["h"] for m in members]))
                    ones.append((own[:, None, :] == np.arange(bins)[None, :, None]).reshape(-1, own.shape[1]).astype(np.float32))
                n = ones[0].shape[1]
                c = (ones[0] @ ones[1].T).astype(float).reshape(len(names[0]), bins, len(names[1]), bins)
                joint = np.log(n) - (c * np.log(np.maximum(c, 1))).sum((1, 3)) / n
                i, j = _pairs_of(*names, same)
                yield pd.DataFrame({"snapshot": snapshot, **_named(names[0][i], names[1][j]), "h1": h[0][i], "h2": h[1][j], "h": joint[i, j]})

    out = tiles(arrays, "snapshot", tile).mapInPandas(run, "snapshot int, s1 string, s2 string, h1 double, h2 double, h double")
    scale = F.sqrt(F.col("h1") * F.col("h2"))
    nmi = F.when(scale > 1e-10, (F.col("h1") + F.col("h2") - F.col("h")) / scale).otherwise(0.0)
    out = out.select("snapshot", "s1", "s2", F.least(F.greatest(nmi, F.lit(0.0)), F.lit(1.0)).alias("nmi"))
    return out.withColumn("d", 1 - F.col("nmi"))


def squared_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("d", 1 - F.col("rho") * F.col("rho"))


def both_ways(pairs: DataFrame) -> DataFrame:
    a = pairs.select("snapshot", F.col("s1").alias("src"), F.col("s2").alias("dst"), "d", "rho")
    return a.unionByName(pairs.select("snapshot", F.col("s2").alias("src"), F.col("s1").alias("dst"), "d", "rho"))


def knn_edges(pairs: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Directed rows of the undirected graph in which each node has its k nearest, ties by name."""
    rows = both_ways(pairs)
    near = rows.withColumn("n", F.row_number().over(Window.partitionBy("snapshot", "src").orderBy(F.round("d", digits), "dst"))).where(F.col("n") <= k).drop("n")
    back = near.select("snapshot", F.col("dst").alias("src"), F.col("src").alias("dst"), "d", "rho")
    return near.unionByName(back).groupBy("snapshot", "src", "dst").agg(F.min("d").alias("d"), F.min("rho").alias("rho"))


def threshold_edges(pairs: DataFrame, limit: float) -> DataFrame:
    return both_ways(pairs).where(F.col("d") < limit)


# Functions of graphs take further key columns, `by`, if they get the edges of several graphs of a
# snapshot at once.


def nodes(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """snapshot, src of every series that is in a snapshot, isolates included."""
    return pairs.select(*by, "snapshot", F.explode(F.array("s1", "s2")).alias("src")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Degree of every node, 0 for isolates."""
    keys = [*by, "snapshot", "src"]
    n = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("degree"))


def turnover(edges: DataFrame, nodes: DataFrame, step: int, by: tuple[str, ...] = ()) -> DataFrame:
    """1 - |previous and current neighbours| / max(1, degree); null where the node was absent."""
    keys = [*by, "snapshot", "src"]
    deg = degrees(nodes, edges, by)
    before = edges.select(*by, (F.col("snapshot") + step).alias("snapshot"), "src", "dst")
    same = edges.join(before, [*keys, "dst"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("same"))
    was = nodes.select(*by, (F.col("snapshot") + step).alias("snapshot"), "src", F.lit(True).alias("was"))
    out = deg.join(was, keys, "left").join(same, keys, "left")
    return out.select(*keys, "degree", F.when(F.col("was"), 1 - F.coalesce("same", F.lit(0)) / F.greatest("degree", F.lit(1))).alias("turnover"))


def triangles(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The keys, src and t, the number of triangles that a node is in, where there are any.

    Each edge is directed from the end with fewer neighbours to the one with more (ties by name), and
    two edges that leave a node are looked up for the third. A node that is left by n edges has n
    neighbours with n edges each at least, so n is no more than the root of twice the graph's edges:
    a hub's neighbours are never paired with one another."""
    keys = [*by, "snapshot"]
    e = edges.select(*keys, "src", "dst")
    n = e.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("n"))
    sized = e.join(n, [*keys, "src"]).join(n.select(*keys, F.col("src").alias("dst"), F.col("n").alias("m")), [*keys, "dst"])
    up = sized.where(F.struct("n", "src") < F.struct("m", "dst")).select(*keys, F.col("src").alias("c"), F.col("dst").alias("a"))
    two = up.join(up.withColumnRenamed("a", "b"), [*keys, "c"]).where("a < b")
    closed = two.join(e.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")), [*keys, "a", "b"])
    return closed.select(*keys, F.explode(F.array("a", "b", "c")).alias("src")).groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("t"))


def clustering(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Local clustering coefficient from the triangles; 0 below two neighbours."""
    keys = [*by, "snapshot", "src"]
    d = degrees(nodes, edges, by).join(triangles(edges, by), keys, "left")
    value = F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1)))
    return d.select(*keys, value.alias("clustering"))


def global_clustering(local: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean local coefficient over all nodes of a snapshot, isolates included."""
    return local.groupBy(*by, "snapshot").agg(F.avg("clustering").alias("clustering"))


def with_saved_signs(edges: DataFrame, pairs: DataFrame, stride: int) -> DataFrame:
    """The edges with the correlations of the latest saved snapshot: of the snapshots in order every
    `stride`-th is saved, from the first on. rho is null where the pair was not in that snapshot."""
    order = Window.orderBy("snapshot")  # of snapshots alone
    numbered = pairs.select("snapshot").distinct().withColumn("o", F.row_number().over(order) - 1)
    source = numbered.select("snapshot", (F.col("o") - F.col("o") % stride).alias("o")).join(numbered.select("o", F.col("snapshot").alias("saved")), "o").drop("o")
    known = pairs.select(F.col("snapshot").alias("saved"), "s1", "s2", F.col("rho").alias("rho"))
    e = edges.drop("rho").join(source, "snapshot").withColumn("s1", F.least("src", "dst")).withColumn("s2", F.greatest("src", "dst"))
    return e.join(known, ["saved", "s1", "s2"], "left").select("snapshot", "src", "dst", "d", "rho")


def _weight(kernel: str, rate: float) -> Column:
    return 1 / F.greatest("d", F.lit(1e-8)) if kernel == "inverse" else F.exp(-rate * F.col("d"))


def neighbour_means(edges: DataFrame, values: DataFrame, column: str, kernel: str = "inverse", rate: float = 5.0) -> DataFrame:
    """Weighted mean of the neighbours' `column`, all and by the sign of the correlation; a neighbour
    without a known sign counts as negative."""
    out = neighbour_features(edges, values, [column], kernel, rate)
    return out.select("snapshot", "src", *(F.col(f"net_idw{s}_{column}").alias(f"idw{s}") for s in ("", "_pos", "_neg")))


def neighbour_features(edges: DataFrame, values: DataFrame, columns: list[str], kernel: str | Column = "inverse", rate: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """net_idw_{c}, net_idw_pos_{c} and net_idw_neg_{c} of all columns from one join; missing values
    are skipped, a mean of none is null. `kernel` may be the weights' expression."""
    v = values.select(F.col("i").alias("snapshot"), F.col("series").alias("dst"), *columns)
    rows = edges.join(v, ["snapshot", "dst"]).withColumn("w", _weight(kernel, rate) if isinstance(kernel, str) else kernel)
    pos = F.coalesce(F.col("rho") > 0, F.lit(False))
    out = []
    for c in columns:
        there = F.col(c).isNotNull()
        for name, on in (("", there), ("_pos", there & pos), ("_neg", there & ~pos)):
            out.append(F.try_divide(F.sum(F.when(on, F.col("w") * F.col(c))), F.sum(F.when(on, F.col("w")))).alias(f"net_idw{name}_{c}"))
    return rows.groupBy(*by, "snapshot", "src").agg(*out)


def rank_features(edges: DataFrame, values: DataFrame, columns: list[str] | str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Values of the columns and distance of each node's r-th nearest neighbour in the graph, r < k."""
    columns = [columns] if isinstance(columns, str) else columns
    v = values.select(F.col("i").alias("snapshot"), F.col("series").alias("dst"), *columns)
    r = F.row_number().over(Window.partitionBy(*by, "snapshot", "src").orderBy(F.round("d", 9), "dst")) - 1
    near = edges.withColumn("r", r).where(F.col("r") < k).join(v, ["snapshot", "dst"], "left")
    at = lambda i, c: F.max(F.when(F.col("r") == i, F.col(c)))
    out = [at(i, c).alias(f"net_nn{i}_{c}") for i in range(k) for c in columns] + [at(i, "d").alias(f"net_nn{i}_dist") for i in range(k)]
    return near.groupBy(*by, "snapshot", "src").agg(*out)


def carried(rows: DataFrame, keys: list[str], order: str, columns: list[str], size: int = 512) -> DataFrame:
    """The rows with the last known value of each column up to and including the row, by the numbers in
    `order`. Known values are carried on inside blocks of `size` numbers; what a block hands to the
    later ones is a table of one row a block, so that no task sorts a key's whole history."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / size))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))
    ends = ends.select(*keys, "_block", *(F.last(c, ignorenulls=True).over(before).alias(f"_{i}") for i, c in enumerate(columns)))
    found = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).join(ends, [*keys, "_block"], "left")
    return found.withColumns({c: F.coalesce(c, f"_{i}") for i, c in enumerate(columns)}).select(*(c for c in rows.columns if c != "_block"))


VALUES = ["log_RV1", "log_RV5", "log_RV22", "Returns"]


def feature_names(columns: list[str], k: int) -> list[str]:
    """All columns that `graph_features` adds, in order."""
    return [
        "net_degree", "net_degree_change", "net_node_clustering", "net_global_clustering", "net_avg_abs_corr",
        *(f"net_idw{s}_{c}" for s in ("", "_pos", "_neg") for c in columns),
        *(f"net_nn{i}_{c}" for i in range(k) for c in columns), *(f"net_nn{i}_dist" for i in range(k)),
    ]


def graph_features(pairs: DataFrame, edges: DataFrame, values: DataFrame, k: int, step: int, columns: list[str] = VALUES, kernel: str = "inverse", rate: float = 5.0, stride: int = 1) -> DataFrame:
    """snapshot, src and every feature of the nodes. `values` is the panel with the columns that
    neighbours lend, their last known values carried forward to the snapshot's date; `pairs` and
    `edges` are written tables, as several parts read them."""
    values = carried(values.select("series", "i", *columns), ["series"], "i", columns)
    everyone = nodes(pairs)
    signed = with_saved_signs(edges, pairs, stride) if stride > 1 else edges
    keys = ["snapshot", "src"]
    local = clustering(edges, everyone)
    out = turnover(edges, everyone, step).withColumnsRenamed({"degree": "net_degree", "turnover": "net_degree_change"})
    out = out.join(local.withColumnRenamed("clustering", "net_node_clustering"), keys, "left")
    out = out.join(global_clustering(local).withColumnRenamed("clustering", "net_global_clustering"), "snapshot", "left")
    out = out.join(pairs.groupBy("snapshot").agg(F.avg(F.abs("rho")).alias("net_avg_abs_corr")), "snapshot", "left")
    out = out.join(neighbour_features(signed, values, columns, kernel, rate), keys, "left")
    return out.join(rank_features(edges, values, columns, k), keys, "left").select(*keys, *feature_names(columns, k))


def with_network(panel: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """The panel with the node features of the latest snapshot, column by column."""
    f = features.select(F.col("snapshot").alias("i"), F.col("src").alias("series"), *columns)
    return carried(panel.join(f, ["series", "i"], "left"), ["series"], "i", columns)


def on_dates(features: DataFrame, dates: DataFrame) -> DataFrame:
    """The rows of `features` on the dates of `dates`."""
    return features.join(dates.select("dt").distinct(), "dt", "left_semi")


def degree_table(deg: DataFrame, series: list[str]) -> DataFrame:
    """snapshot, and one column of degrees for each series, null where it is not in the snapshot."""
    return deg.groupBy("snapshot").pivot("src", series).agg(F.first("degree"))


def as_of(panel: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """The node features of the latest snapshot on every date of each series, column by column."""
    f = features.select(F.col("snapshot").alias("i"), F.col("src").alias("series"), *columns)
    return carried(panel.select("series", "dt", "i").join(f, ["series", "i"], "left"), ["series"], "i", columns).select("series", "dt", *columns)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst").groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_edges"))


def ego(edges: DataFrame, centre: str, k: int) -> DataFrame:
    """Edges src < dst among `centre` and its `k` closest neighbours, by snapshot."""
    w = Window.partitionBy("snapshot").orderBy(F.round("d", 9), "dst")
    near = edges.where(F.col("src") == centre).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("snapshot", F.col("dst").alias("node"))
    nodes = near.unionByName(near.select("snapshot", F.lit(centre).alias("node")).distinct())
    out = edges.where("src < dst")
    for end in ("src", "dst"):
        out = out.join(nodes.withColumnRenamed("node", end), ["snapshot", end], "left_semi")
    return out.select("snapshot", "src", "dst", "d", "rho")


def neighbourhood_change(edges: DataFrame) -> DataFrame:
    """Each node's neighbours in the first and the last snapshot: stable, lost or gained."""
    ends = edges.agg(F.min("snapshot").alias("lo"), F.max("snapshot").alias("hi"))
    rows = edges.join(F.broadcast(ends)).where("snapshot in (lo, hi)").groupBy("src", "dst")
    old, new = F.bool_or(F.col("snapshot") == F.col("lo")), F.bool_or(F.col("snapshot") == F.col("hi"))
    return rows.agg(F.when(old & new, "stable").when(old, "lost").otherwise("gained").alias("change"))
