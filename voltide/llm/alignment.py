"""Alignment of the tokens of two tokenizers by the bytes that they stand for.

Both tokenizers cut the same bytes, so each token is a range of them. A batch's tokens stand in two
tables by document and first byte; pandas' merge_asof finds for the start of each token the other
side's token that covers it, in both directions, and the union of both are all pairs of tokens whose
ranges overlap. Places where tokens of both sides end cut a document into groups.

How many documents hold a pair of ids linked is counted over the corpus, by each document's distinct
pairs; these counts are brought back to the documents by a join on the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.bytepair import BytePairs
from voltide.llm.common import materialise, slices, small_batches, unused

#: Pairs, of two numbers each, up to which their counts are sent to all tasks: 16 bytes a pair there.
MOST_SENT = 6_000_000

MARK = "▁"


class Pieces:
    """Encoder of a SentencePiece model, and the bytes of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = {}
        for i in range(len(self.sp)):
            piece = self.sp.id_to_piece(i)
            self.tokens[i] = bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace(MARK, " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.sp.encode(text, num_threads=1)


class Side:
    """One side's tokens of some documents: ids, document, first byte and place behind, of all documents
    one behind the other."""

    def __init__(self, ids: list, lengths: np.ndarray):
        self.n = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.end = np.cumsum(lengths[self.ids])
        self.start = self.end - lengths[self.ids]
        self.at = np.concatenate(([0], np.cumsum(self.n)))  # first token of each document

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "start": self.start, "token": np.arange(len(self.ids))})


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of all pairs whose ranges overlap, each pair once."""
    one, two = a.table(), b.table()
    over = pd.merge_asof(one, two, on="start", by="doc", suffixes=("", "_other"))
    back = pd.merge_asof(two, one, on="start", by="doc", suffixes=("", "_other"))
    more = a.start[back["token_other"].to_numpy()] != b.start  # those that start together were found already
    first = np.concatenate((over["token"].to_numpy(), back["token_other"].to_numpy()[more]))
    second = np.concatenate((over["token_other"].to_numpy(), back["token"].to_numpy()[more]))
    return first, second


class Writer:
    """The texts of groups: ids of A joined by commas, a bar, ids of B; groups joined by semicolons."""

    def __init__(self, n_a: int, n_b: int):
        self.shift = 2 * n_a
        self.parts = [f"{i}{end}" for i in range(n_a) for end in (",", "|")] + [f"{i}{end}" for i in range(n_b) for end in (",", ";", "")]

    def texts(self, a: Side, b: Side) -> tuple[list[str], np.ndarray]:
        """The text of each document, and its number of groups."""
        last_a, last_b = np.isin(a.end, b.end), np.isin(b.end, a.end)
        group_a, group_b = (np.concatenate(([0], np.cumsum(x)[:-1])) if len(x) else np.zeros(0, np.int64) for x in (last_a, last_b))
        n = int(last_a.sum())
        behind_a, behind_b = np.cumsum(np.bincount(group_a, minlength=n)), np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=n))))
        code = np.zeros(len(a.ids) + len(b.ids), np.int64)
        code[np.arange(len(a.ids)) + behind_b[group_a]] = 2 * a.ids + last_a
        final = np.zeros(len(b.ids), bool)
        final[b.at[1:][b.n > 0] - 1] = True
        code[np.arange(len(b.ids)) + behind_a[group_b]] = self.shift + 3 * b.ids + last_b + final
        at = a.at + b.at
        groups = np.bincount(a.doc[last_a], minlength=len(a.n))
        get = self.parts.__getitem__
        return ["".join(map(get, code[s:e].tolist())) for s, e in zip(at[:-1], at[1:], strict=True)], groups


FIELDS = {"n_a": (pa.int64(), "long"), "n_b": (pa.int64(), "long"), "n_groups": (pa.int64(), "long"), "groups": (pa.string(), "string"), "groups_sha256": (pa.string(), "string"), "n_links": (pa.int64(), "long"), "pairs": (pa.list_(pa.int64()), "array<long>"), "times": (pa.list_(pa.int32()), "array<int>")}


class Aligner:
    def __init__(self, tokenizer: str, model: bytes):
        self.a, self.b = BytePairs(tokenizer, specials=False), Pieces(model)
        self.long_a, self.long_b = (np.array([len(x.tokens.get(i, b"")) for i in range(max(x.tokens) + 1)], np.int64) for x in (self.a, self.b))
        self.width = len(self.long_b)
        self.writer = Writer(len(self.long_a), len(self.long_b))

    def tokens(self, text: str) -> tuple:
        """The ids of both sides; none if the bytes of either are not those of the text with a space
        before it."""
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text), self.b.encode(text)
        good = all(b"".join(map(x.tokens.__getitem__, ids)) == want for x, ids in ((self.a, a), (self.b, b)))
        return (a, b) if good else ((), ())

    def align(self, texts: list[str | None], fields: tuple[str, ...]) -> dict[str, list]:
        found = [self.tokens(t) if t else ((), ()) for t in texts]
        a, b = Side([x for x, _ in found], self.long_a), Side([y for _, y in found], self.long_b)
        groups, n_groups = self.writer.texts(a, b)
        one, two = overlaps(a, b)
        doc, pair = a.doc[one], a.ids[one] * self.width + b.ids[two]
        held, times = np.unique(doc << 40 | pair, return_counts=True)
        at = np.searchsorted(held >> 40, np.arange(len(texts) + 1)).astype(np.int32)
        out = {
            "n_a": lambda: a.n, "n_b": lambda: b.n, "n_groups": lambda: n_groups, "groups": lambda: groups,
            "groups_sha256": lambda: [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups, a.n, strict=True)],
            "n_links": lambda: np.bincount(doc, minlength=len(texts)),
            "pairs": lambda: pa.ListArray.from_arrays(pa.array(at), pa.array(held & ((1 << 40) - 1))),
            "times": lambda: pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32))),
        }
        return {f: out[f]() for f in fields}


def alignments(docs: DataFrame, tokenizer: str, model: str, text: str = "text", fields: tuple[str, ...] = ("n_a", "n_b", "n_groups", "groups", "n_links")) -> tuple[DataFrame, str]:
    """Add a struct column with the named FIELDS of every text; returns the frame and its name.

    `tokenizer` is a byte-level file of the tokenizers library (A, of a space and the text; strings of
    special tokens are ordinary text), `model` a SentencePiece model that puts a space before a text (B).
    `groups` is `a1,a2|b1;a3|b2,b3`, `pairs` are the distinct pairs of linked ids as A's id times B's
    number of ids, plus B's id, ascending, and `times` how often each is linked. A text that is null or
    empty, or whose bytes a side does not give back, has no tokens: zeros and an empty text. Rows are
    judged by themselves and all their columns stay.
    """
    small_batches(docs.sparkSession)
    name = unused(docs, "aligned")
    with open(tokenizer, encoding="utf-8") as f, open(model, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` struct<{','.join(f'{f}:{FIELDS[f][1]}' for f in fields)}>"])
    arrow = [pa.field(f, FIELDS[f][0]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*sent.value)
        for batch in slices(batches, text, 1_000_000):  # some dozen numbers a token
            got = aligner.align(batch.column(text).to_pylist(), fields)
            parts = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type) for f in arrow]
            column = pa.StructArray.from_arrays(parts, fields=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, kind), name


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """pair, n, best: of one column `pair` with a row for each document and linked pair of ids, in how
    many documents each is, and whether no pair of the same A id is in more."""
    counts = materialise(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.floor(F.col("pair") / width).cast("int")
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A at most
    return materialise(counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), counts)


def link_statistics(docs: DataFrame, tokenizer: str, model: str, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of `docs`.

    An id pair's count is the number of rows that hold it linked. n_best is the number of links whose
    count is the highest of their A id's (ties included), count_sum the sum of the links' counts. See
    `alignments` for texts without tokens. The counts' size is looked at: those of pairs in two documents
    or more are sent to all tasks if they are `most_sent` at most (a pair that is not among them is in
    one), else documents' pairs and counts are both shuffled by the pair.
    """
    fields = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    df, name = alignments(docs.select("doc_id", "text"), tokenizer, model, fields=fields)
    rows = materialise(df.select("doc_id", F.monotonically_increasing_id().alias("row"), *(F.col(f"{name}.{f}").alias(f) for f in fields)))
    counts = pair_counts(rows.select(F.explode("pairs").alias("pair")), _width(model))
    often = counts.where("n > 1 or not best").select("pair", F.when(F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    out = [c for c in rows.columns if c not in ("row", "pairs", "times")]
    if often.count() <= most_sent:
        found = often.toArrow().sort_by("pair")
        sent = docs.sparkSession.sparkContext.broadcast((found["pair"].to_numpy(), found["n"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = sent.value
            for b in batches:
                pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy()
                own = pairs.flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), np.diff(pairs.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                n = np.where(keys[at] == own, values[at], 1) if len(keys) else np.ones(len(own), np.int64)
                sums = []
                for value in (np.where(n > 0, times, 0), np.abs(n) * times):
                    total = np.zeros(b.num_rows, np.int64)
                    np.add.at(total, row, value)
                    sums.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), *sums], names=[*out, "n_best", "count_sum"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in out)
        return rows.drop("row").mapInArrow(run, f"{kinds}, n_best long, count_sum long").select(*_ORDER)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    links = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return rows.join(links, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*_ORDER)


_ORDER = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _width(model: str) -> int:
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=model))
