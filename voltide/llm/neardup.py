"""Near-duplicate detection by min-max hashing.

A document is the set of its word shingles. Under each of some hash functions both the minimum and
the maximum are kept, which halves the evaluations for a signature of a given length; the signature
is cut into bands and documents that agree on a band are candidates. Documents with equal sets are
one class, represented by its first row, and only classes take part from there on.

Candidates are confirmed on their full sets, but never paired with one another all at once. First
come light rounds: of each component in a band's bucket one member stands for it and is held against
one member of the bucket's largest component; each component has its most promising pair confirmed,
and links join components. When a round joins nothing, what is left is compared exhaustively: in
every bucket the members outside its largest component with those of the other components. So each
candidate pair is compared or already connected, and members of one component never meet.

Before sets are read, a pair has to pass a bound that never errs: one bit for each of 1,024 cells
holds the parity of the shingles that fall into it. Two sets' cells of different parity hold at
least one shingle each that is not in both, so their number is no more than the symmetric
difference, which similarity bounds from above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import discard, looked_up, materialise

#: Cells of the parity bound, in numbers of 64 bits.
CELLS = 16


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles of the whole text."""
    # of bytes, lower() turns A-Z alone and split() cuts at exactly the six ASCII white space characters
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > 200_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):  # the place of a word in its shingle counts
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class _Hashes(dict):
    """64-bit hashes of the words that this process has met since it was last emptied."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def parities(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each cell, 64 cells to a number."""
    odd = np.bincount((s & np.uint64(64 * CELLS - 1)).astype(np.int64), minlength=64 * CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Signer:
    """Band hashes of min-max signatures: `bands` bands of `rows` values each. Values are the upper
    half of a shingle's hash times an odd number, modulo 2^32: a permutation of 32-bit numbers."""

    def __init__(self, bands: int, rows: int, seed: int = 17):
        if rows % 2:
            raise ValueError("a band holds as many minima as maxima")
        r = np.random.default_rng(seed)
        n = bands * rows // 2
        self.a = r.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.bands, self.rows = bands, rows
        self.room = np.empty((n, 2048), np.uint32)

    def values(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The minima and the maxima of a set under all permutations."""
        low, high = np.full(len(self.a), 2**32 - 1, np.uint32), np.zeros(len(self.a), np.uint32)
        s = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(s), 2048):
            part = s[None, at : at + 2048]
            v = np.multiply(self.a[:, None], part, out=self.room[:, : part.shape[1]])
            np.minimum(low, v.min(1), out=low)
            np.maximum(high, v.max(1), out=high)
        return low, high

    def bands_of(self, s: np.ndarray) -> np.ndarray:
        low, high = self.values(s)
        both = np.concatenate((low.reshape(self.bands, -1), high.reshape(self.bands, -1)), 1).astype(np.uint64)
        out = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            out = (out ^ both[:, j]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def _text_key() -> Column:
    return F.unhex(F.md5("text"))


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Per row, its columns but the text, and n, digest, bands and cells of its set (null: no words)."""
    kept = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")

    def run(batches):
        signer = Signer(bands, rows)
        for b in batches:
            sizes, digests, signs, cells = [], [], [], []
            for t in b["text"]:
                s = shingles(t, k)
                sizes.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                signs.append(signer.bands_of(s) if len(s) else None)
                cells.append(parities(s) if len(s) else None)
            # ids go through as texts: a null would turn a column of numbers into floats
            yield pd.DataFrame({**{c: b[c] for c in kept}, "n": sizes, "digest": digests, "bands": signs, "cells": cells})

    return docs.mapInPandas(run, f"{kinds}, n long, digest binary, bands array<long>, cells array<long>")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """rep and shingle set of the classes in `ids` (rep, h), from any one row with that text."""

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                yield pd.DataFrame({"rep": part["rep"], "s": [shingles(t, k).view(np.int64) for t in part["text"]]})

    rows = looked_up(docs.select(_text_key().alias("h"), "text"), ids, "h").groupBy("rep").agg(F.first("text").alias("text"))
    return rows.mapInPandas(run, "rep long, s array<long>")


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of narrow rows and no more than `rows` of them, in tasks of 250,000 rows: what shrinks
    from round to round is not written in as many files as at first."""
    return df.coalesce(-(-rows // 250_000) or 1)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that can be reached) for the nodes of `edges` (a, b), by
    alternating large-star and small-star steps until nothing changes. No neighbourhood is ever
    gathered: each step takes minima and joins."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        most = 2 * e.count()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialise(_narrow(large, most), e)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = materialise(_narrow(small, most), large)
        # done when every node has one edge, to a node that has none: stars
        ends = small.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(small.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").limit(1).count():
            break
        e = small
    out = small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return materialise(_narrow(out, most), small)


def _differ(x: str, y: str) -> Column:
    """Cells of different parity: no more than the symmetric difference of the two sets."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(CELLS)), F.lit(0))


def _possible(percent: int) -> Column:
    """Whether the sizes and the cells of a pair allow the similarity. Intersection over union is at
    least p exactly if the symmetric difference is at most (1 - p) / (1 + p) of the sizes' sum."""
    sizes = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    return sizes & ((100 + percent) * _differ("cells", "cells2") <= (100 - percent) * (F.col("n") + F.col("n2")))


def _largest(live: DataFrame) -> DataFrame:
    """band, largest, first: the component with the most members of each bucket that holds two
    components or more, and one of its members."""
    held = live.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("first"))
    top = held.groupBy("band").agg(F.max_by(F.struct("c", "first"), F.struct("m", -F.col("c"))).alias("t"), F.count(F.lit(1)).alias("held"))
    return top.where("held > 1").select("band", F.col("t.c").alias("largest"), F.col("t.first").alias("first"))


def _promising(live: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b, ca, cb: for every component outside the largest of its buckets one pair, of a member of
    its own and one of a largest component: of those that sizes and cells allow, the one whose cells
    differ least."""
    one = live.join(_largest(live), "band").where("c <> largest").groupBy("band", "c").agg(F.min("rep").alias("a"), F.first("largest").alias("cb"), F.first("first").alias("b"))
    pairs = one.select("a", "b", F.col("c").alias("ca"), "cb").distinct()
    own = members.select(F.col("rep").alias("a"), "n", "cells")
    other = members.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("cells").alias("cells2"))
    pairs = pairs.join(own, "a").join(other, "b").where(_possible(percent))
    far = _differ("cells", "cells2") / (F.col("n") + F.col("n2"))
    return pairs.groupBy("ca").agg(F.min_by(F.struct("a", "b", "cb"), F.struct(far, "b", "a")).alias("t")).select("t.a", "t.b", "ca", "t.cb")


def _remaining(live: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a < b, ca, cb: all pairs of a bucket that are of different components, one of which is not
    the bucket's largest, and that sizes and cells allow."""
    rest = live.join(_largest(live).select("band", "largest"), "band").join(members.select("rep", "n", "cells"), "rep")
    rest = rest.select("band", "rep", "n", "cells", "c", "largest")
    outside = rest.where("c <> largest").select("band", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("cells").alias("cells2"))
    # both outside: once, from the larger one
    pairs = rest.join(outside, "band").where((F.col("c") != F.col("c2")) & ((F.col("c") == F.col("largest")) | (F.col("rep") < F.col("rep2"))) & _possible(percent))
    turned = F.col("rep") > F.col("rep2")
    ordered = {"a": ("rep2", "rep"), "b": ("rep", "rep2"), "ca": ("c2", "c"), "cb": ("c", "c2")}
    return pairs.select(*(F.when(turned, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in ordered.items())).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (components) of the pairs whose full sets are similar enough."""
    one = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    full = pairs.join(one, "a").join(two, "b")
    return full.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, row_key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Words are runs of non-white-space after lower-casing A-Z; a text with fewer than `k` words is one
    shingle; one without words has none, is linked with nothing and is kept. Linked are documents
    with 100 * intersection >= `percent` * union; component_id is the smallest doc_id that can be
    reached. A pair is found if it agrees on a band. Were its values independent, a pair at
    similarity 0.8 would agree on none of 42 bands of 6 with probability 3e-6; minimum and maximum of
    one permutation are not quite independent in small sets (4e-5 for a union of five shingles).
    Every row is a document of its own, linked by its text alone, whether or not its doc_id is null
    or is repeated; a component without any doc_id has a null component_id. One row of a component
    is kept, the first of those with its smallest doc_id. Only doc_id and text are read, and
    `row_key` if given: a column as `keyed` adds it, which then is returned as well.
    """
    own = F.col("doc_id").cast("long").cast("string").alias("doc_id")
    given = [F.col(row_key).alias("given")] if row_key else []
    wide = _signed(docs.select(own, *given, _text_key().alias("h"), "text"), k, bands, rows)
    # a number of its own for every row, written once
    key = F.col("given") if row_key else F.monotonically_increasing_id()
    wide = materialise(wide.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", key).drop("given"))
    # the row to keep: ids in order, rows without one last
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = F.struct("h", "n", "bands", "cells")
    classes = wide.where("digest is not null").groupBy("digest").agg(F.min("key").alias("rep"), F.min(least).alias("least"), F.min_by(first, "key").alias("x"))
    classes = materialise(classes.select("digest", "rep", "least", "x.*"))
    signed = materialise(wide.select("key", "doc_id", F.col("n").alias("n_shingles"), "digest"), wide)
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = materialise(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band"))
    # the members of each bucket, and their components so far
    live = materialise(banded.join(shared, "band").select("band", "rep", F.col("rep").alias("c")), shared)
    members = materialise(classes.select("rep", "h", "n", "cells").join(live.select("rep").distinct(), "rep", "left_semi"))
    label = materialise(classes.select("digest", "least", F.col("rep").alias("label")), classes)
    sets = materialise(_sets(docs.select("text"), members.select("rep", "h"), k))
    steps: list[DataFrame] = []
    exhaustive, left = False, live.count()
    while True:
        pairs = materialise(_narrow((_remaining if exhaustive else _promising)(live, members, percent), left))
        # links between components only: what is joined already is one node from now on
        links = materialise(_narrow(_confirmed(pairs, sets, percent), left), pairs)
        joined = links.count()
        if joined:
            steps.append(components(links))
        discard(links)
        if exhaustive:
            break
        exhaustive = not joined
        if joined:
            moved = live.join(steps[-1], F.col("c") == F.col("node"), "left").select("band", "rep", F.coalesce("root", "c").alias("c"))
            live = materialise(_narrow(moved, left), live)
    discard(live, members, sets)
    whole = label
    for step in steps:
        label = label.join(step, F.col("label") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "label").alias("label"))
    label = materialise(label, whole, *steps)
    label = label.drop("least").join(label.groupBy("label").agg(F.min("least").alias("least")), "label").drop("label")
    member = signed.join(label, "digest", "left")
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = F.coalesce(F.col("key") == F.col("least.key"), F.lit(True))
    return member.select("doc_id", *([F.col("key").alias(row_key)] if row_key else []), "n_shingles", component.alias("component_id"), kept.alias("kept"))
