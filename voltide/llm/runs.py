"""Periodic runs of words: Baier's grouping gives the Lyndon arrays, whose roots are extended to runs.

A run is a stretch of consecutive words with smallest period q that no neighbour extends and that holds
`least` words and `times` periods. By the theorem of runs, one of the two orders of the words (as
numbered, and reversed) has a root of each run as the longest Lyndon word at its start. The first
phase of Baier's suffix sorter finds these words for all positions: groups of suffixes, which begin as
those with the same first word, are taken from the highest down; each suffix of a group is handed to
the nearest one before it that is in a lower group, and lengthens that one's word by its own. A root is
extended both ways by the longest common extensions of its two ends, looked up in ranks of blocks
whose lengths are powers of two.

Nearly all words of ordinary texts are in no run, and that is seen before: with four periods or more,
every three consecutive words of a run occur three times in it. Only stretches of such words, of the
least length, are grouped. Hashes that meet by chance leave a few words too many there, never too few.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import slices, unused

#: Words of stretches that are grouped together; one longer stretch stands alone.
CHUNK = 200_000
#: Buckets in which three-word passages are counted.
BUCKETS = 1 << 21

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: What can be computed for a text, in Arrow and in Spark.
FIELDS = {
    "n_runs": (pa.int64(), "long"),
    "runs": (pa.list_(RUN), "array<struct<start:long,length:long,period:long>>"),
    "best": (pa.struct([*RUN, ("exponent_milli", pa.int64())]), "struct<start:long,length:long,period:long,exponent_milli:long>"),
    "collapsed": (pa.string(), "string"),
    "runs_sha256": (pa.string(), "string"),
    "collapsed_sha256": (pa.string(), "string"),
}


def lyndon(x: list[int], top: int) -> list[int]:
    """Length of the longest Lyndon word at every position of `x`, numbers from 0 to `top` - 1. A 0 ends
    a stretch: it is lower than all, no word holds it, and its own entry is 0."""
    n = len(x)
    members: list[list[int]] = [[] for _ in range(top)]
    for i, c in enumerate(x, 1):  # positions count from 1; 0 is before the first
        members[c].append(i)
    group, size = [0, *x], [1] * top
    above, below = list(range(1, top + 1)), list(range(-1, top - 1))
    link = list(range(n + 1))  # the nearest position, itself included, that is not done
    out = [0] * (n + 1)
    last = top - 1
    while last > 0:
        g, u = last, size[last]
        last = below[last]
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            out[i], link[i] = u, i - 1
        handed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while link[j] != j:
                j = link[j]
            k = i
            while link[k] != j:
                link[k], k = j, link[k]
            if group[j]:
                handed[j] = handed.get(j, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for j, k in handed.items():
            parts.setdefault((group[j], k), []).append(j)
        at = old = -1
        for c, k in sorted(parts):  # of one group, those that got more are higher
            if c != old:
                at = old = c
            new = len(size)
            size.append(size[c] + k * u)
            members.append(parts[c, k])
            for j in parts[c, k]:
                group[j] = new
            if at == last:
                above.append(new + 1)
                last = new
            else:
                above.append(above[at])
                below[above[at]] = new
            above[at] = new
            below.append(at)
            at = new
    return out[1:]


class Extensions:
    """Longest common extensions of positions of `x`, in which nothing beyond `longest` is equal."""

    def __init__(self, x: np.ndarray, longest: int):
        self.n, self.ranks = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int32)]
        while (1 << len(self.ranks)) <= longest:
            r, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            found, r = np.unique(r[:-half].astype(np.int64) << 32 | r[half:], return_inverse=True)
            if len(found) == len(r):
                break
            self.ranks.append(r.astype(np.int32))

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i < j."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[k]
            a, b = i + total, j + total
            on = b < len(r)
            on[on] = r[a[on]] == r[b[on]]
            total[on] += 1 << k
        return total

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal; i < j."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[k]
            a, b = i - total - (1 << k), j - total - (1 << k)
            on = a >= 0
            on[on] = r[a[on]] == r[b[on]]
            total[on] += 1 << k
        return total


def runs_of(words: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows of start, length and period of the runs of stretches, by start and period. `words` holds the
    stretches one behind the other, as numbers; `ends` are the places behind each."""
    sizes = np.diff(ends, prepend=0)
    stretch = np.repeat(np.arange(len(ends)), sizes)
    place = np.arange(len(words)) + stretch  # a separator behind each stretch
    names, ranks = np.unique(words, return_inverse=True)
    apart = np.cumsum(sizes + 1) - 1
    x = np.zeros(len(words) + len(ends), np.int64)
    x[place] = ranks + 1
    distinct = x.copy()
    distinct[apart] = -1 - np.arange(len(ends))
    lce = Extensions(distinct, int(sizes.max(initial=0)))
    found = []
    for order in (ranks + 1, len(names) - ranks):
        x[place] = order
        q = np.array(lyndon(x.tolist(), len(names) + 1), np.int64)
        i = np.flatnonzero(q)
        q = q[i]
        same = distinct[np.minimum(i + q, len(x) - 1)] == distinct[i]
        same |= (i > 0) & (distinct[i - 1] == distinct[i + q - 1])
        i, q = i[same], q[same]
        back, on = lce.before(i, i + q), lce.after(i, i + q)
        whole = back + q + on
        good = (whole >= least) & (whole >= times * q)
        found.append(np.stack((i - back, whole, q), 1)[good])
    out = np.unique(np.concatenate(found), axis=0)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    out[:, 0] -= np.searchsorted(apart, out[:, 0])
    return out


def stretches(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and places behind of all stretches of texts that can hold a run of four periods:
    `least` words or more, every three of which occur three times in their text."""
    none = np.zeros(0, np.int64)
    if len(words) < least:
        return none, none
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)).astype(np.uint64)
    w = words.astype(np.uint64)
    h = text[:-2]
    for part in (w[:-2], w[1:-1], w[2:]):
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    on = (np.bincount(h, minlength=BUCKETS)[h] >= 3) & (text[:-2] == text[2:])
    # runs of first places of such passages; a run of `least` words has least - 2 of them
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts >= least - 2
    return starts[long], stops[long] + 2


def _found(words: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Runs of texts that stand one behind the other: start among all words, length, period."""
    starts, stops = stretches(words, ends, least)
    out, a = [np.zeros((0, 3), np.int64)], 0
    sizes = np.cumsum(stops - starts)
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, "right")))
        part = np.concatenate([words[s:e] for s, e in zip(starts[a:b], stops[a:b], strict=True)])
        own = np.cumsum(stops[a:b] - starts[a:b])
        got = runs_of(part, own, least)
        at = np.searchsorted(own, got[:, 0], "right")
        got[:, 0] += starts[a:b][at] - np.concatenate(([0], own[:-1]))[at]
        out.append(got)
        a = b
    return np.concatenate(out)


def _values(words: list[list[bytes]], least: int, fields: tuple[str, ...]) -> dict[str, list]:
    """The fields of every text, which is given by its words."""
    numbers: dict[bytes, int] = {}
    new = count()
    for own in words:
        for w in own:
            if w not in numbers:
                numbers[w] = next(new)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((numbers[w] for own in words for w in own), np.int64, int(ends[-1]) if len(ends) else 0)
    found = _found(flat, ends, least)
    firsts = np.searchsorted(found[:, 0], np.concatenate(([0], ends)))
    out: dict[str, list] = {f: [] for f in fields}
    for t, own in enumerate(words):
        base = int(ends[t]) - len(own)
        runs = [(s - base, n, q) for s, n, q in found[firsts[t] : firsts[t + 1]].tolist()]
        collapsed = b" ".join(_kept(own, runs))
        for f in fields:
            if f == "n_runs":
                value = len(runs)
            elif f == "runs":
                value = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
            elif f == "best":
                value = _best(runs)
            elif f == "collapsed":
                value = collapsed.decode()
            elif f == "runs_sha256":
                value = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            else:
                value = hashlib.sha256(collapsed).hexdigest()
            out[f].append(value)
    return out


def _best(runs: list[tuple[int, int, int]]) -> dict[str, int] | None:
    """The run of most periods, exactly; of equal ones the first, by start and period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best and {"start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2]}


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def runs(docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, key: str = "doc_id", text: str = "text", least: int = 6, fields: tuple[str, ...] = ("n_runs", "runs", "best", "collapsed")) -> tuple[DataFrame, str]:
    """Add a struct column with the named FIELDS of every text; returns the frame and its name.

    Words are runs of characters other than ASCII white space, numbered from 0; a run has `least` words
    (6 or more) and four periods or more. `runs` are ordered by start and period; `best` has the highest
    length / period (of equal ones the first; null without runs); `collapsed` are the words that no run
    holds behind its first period, joined by one space. A null or empty text has no words and no runs.
    `rewrite` turns a row's `key` and words into the words to look at. Rows are judged by themselves and
    all their columns stay; a task holds some megabytes of texts, or one longer text, at a time.
    """
    if least < 6:
        raise ValueError("shorter runs than six words are not found")
    name = unused(docs, "found")
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` struct<{','.join(f'{f}:{FIELDS[f][1]}' for f in fields)}>"])
    arrow = [pa.field(f, FIELDS[f][0]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = [(t or "").encode().split() for t in batch.column(text).to_pylist()]
            if rewrite:
                words = [rewrite(k, w) for k, w in zip(batch.column(key).to_pylist(), words, strict=True)]
            got = _values(words, least, fields)
            column = pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], fields=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, kind), name


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query looks at them: one document of ten, by its id's CRC, repeats a passage from
    some place on to its end. A document without an id stays as it is."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * (-(-(n - a) // p)))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run's start, length, period and exponent_milli, and both digests."""
    df, name = runs(docs.select("doc_id", "text"), planted, fields=("n_runs", "best", "runs_sha256", "collapsed_sha256"))
    best = [F.col(f"{name}.best.{c}").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    return df.select("doc_id", F.col(f"{name}.n_runs").alias("n_runs"), *best, F.col(f"{name}.runs_sha256").alias("runs_sha256"), F.col(f"{name}.collapsed_sha256").alias("collapsed_sha256"))
