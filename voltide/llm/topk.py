"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are dealt to blocks of bounded size. A block's index has, for every dimension, segments of
vectors whose component falls in the same band of values. For a query a segment's impact is the most
that its band contributes; segments of all dimensions are processed by descending impact, and the
impacts are gathered per vector. What a vector can still get is bounded, for each of its dimensions
that is not processed yet, by the next impact, which in the end is below zero.
A vector whose bound is below the k-th score known so far is proven out. Processing stops when so few
are left that to rescore them exactly, which then is done, costs less than the postings to come. The best of every block meet in one ranking per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.llm.common import materialise

BAND = 1  # bits: components within 2 of each other share a segment


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every component; rows with a null vector, or with a null or
    non-finite component, take no part."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))


class Index:
    """Segments of one block: positions of vectors by dimension and value band. Vectors stand in the order
    in which ties are given."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, d = x.shape
        band = x >> BAND
        self.dim, self.low, self.high, self.rows = [], [], [], []
        for j in range(d):
            order = np.argsort(band[:, j], kind="stable")
            cuts = np.flatnonzero(np.diff(band[order, j])) + 1
            for seg in np.split(order, cuts):
                if len(seg):
                    self.dim.append(j)
                    self.low.append(x[seg, j].min())
                    self.high.append(x[seg, j].max())
                    self.rows.append(seg)
        self.dim, self.low, self.high = np.array(self.dim, int), np.array(self.low), np.array(self.high)
        self.size = np.array([len(r) for r in self.rows], int)

    def search(self, q: np.ndarray, own: int, k: int, rounds: int = 24) -> list[tuple[int, int]]:
        """The k best (score, position), ties to smaller positions, of all vectors but the one at `own`.
        `self.share` becomes the share of the postings that were processed."""
        x, n = self.x, len(self.x)
        most = np.maximum(q[self.dim] * self.low, q[self.dim] * self.high)
        order = np.argsort(-most, kind="stable")
        ends = np.searchsorted(np.cumsum(self.size[order]), np.arange(1, rounds + 1) * self.size.sum() / rounds) + 1
        bound, dims = np.zeros(n), np.full(n, float(len(q)))  # of dims not processed yet
        alive = np.flatnonzero(np.arange(n) != own)
        best: list[tuple[int, int]] = []
        at, left = 0, int(self.size.sum())
        # on while the postings left cost more than to rescore the possible members
        for end in ends:
            if at >= len(order) or len(alive) <= 8 * k or len(alive) * len(q) <= left / 4:
                break
            end = min(max(int(end), at + 1), len(order))
            part, at = order[at:end], end
            rows = np.concatenate([self.rows[s] for s in part])
            bound += np.bincount(rows, np.repeat(most[part], self.size[part]), n)
            dims -= np.bincount(rows, minlength=n)
            left -= len(rows)
            coming = most[order[at]] if at < len(order) else 0.0  # impacts descend: no dimension adds more
            upper = bound[alive] + dims[alive] * coming
            top = alive[np.argpartition(-upper, min(4 * k, len(alive) - 1))[: 4 * k]]
            exact = x[top] @ q
            found = {*best, *((int(s), int(i)) for s, i in zip(exact, top, strict=True))}
            best = sorted(found, key=lambda r: (-r[0], r[1]))[:k]
            if len(best) == k:
                alive = alive[upper >= best[-1][0] - 0.5]  # proof: the others cannot reach the k-th; scores are whole
        self.share = float(self.size[order[:at]].sum() / max(self.size.sum(), 1))
        exact = x[alive] @ q
        keep = np.lexsort((alive, -exact))[:k]
        both = {*best, *((int(exact[i]), int(alive[i])) for i in keep)}
        return sorted(both, key=lambda r: (-r[0], r[1]))[:k]


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, block_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best inner products of every row that `query` marks
    against all other rows; ties go to the smaller vec_id, rows without one last.

    Every row is a vector of its own: rows that repeat a vec_id, equal or not, are candidates, for each
    other too, and each is asked by itself. Vectors of another length than the query's are not compared.
    Every vector is in exactly one block and every query meets every block: a task holds one block and
    one part of the queries, `block_rows` and `query_rows` vectors at most, so both are copied once for
    every `query_rows` queries and `block_rows` vectors.
    """
    rows = materialise(quantised(vectors, scale).withColumn("key", F.monotonically_increasing_id()))
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    index = rows.withColumn("block", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(blocks)).cast("int"))
    asked = rows.where(query)
    parts = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    # every part of the queries is sent to every block, and every block to every part
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else index.withColumn("part", F.lit(0))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            # ids go through as texts: a null would turn a column of numbers into floats
            none = own["vec_id"].isna()
            own = own.assign(none=none, at=own["vec_id"].where(~none, "0").astype("int64")).sort_values(["none", "at", "key"])
            by = {}
            for d in set(own["v"].map(len)):
                same = own[own["v"].map(len) == d]
                place = {key: i for i, key in enumerate(same["key"])}
                by[d] = Index(np.stack(same["v"]).astype(np.int64).reshape(len(same), d)), place, same["vec_id"].to_list(), same["key"].to_list()
            for asked_id, asked_key, v in zip(queries["asked_id"], queries["asked_key"], queries["asked"], strict=True):
                if len(v) in by:
                    index, place, ids, keys = by[len(v)]
                    out += [(asked_key, asked_id, ids[c], keys[c], s) for s, c in index.search(np.asarray(v, np.int64), place.get(asked_key, -1), k)]
        return pd.DataFrame(out, columns=["asked_key", "query_id", "vec_id", "key", "score"])

    left = left.withColumn("vec_id", F.col("vec_id").cast("string"))
    right = right.select("block", "part", F.col("vec_id").cast("string").alias("asked_id"), F.col("key").alias("asked_key"), F.col("v").alias("asked"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, "asked_key long, query_id string, vec_id string, key long, score long")
    found = found.withColumns({c: F.col(c).cast("long") for c in ("query_id", "vec_id")})
    w = Window.partitionBy("asked_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
