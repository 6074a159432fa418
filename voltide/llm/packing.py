"""Packing of tokenised documents into sequences of one length: bounded-space online best fit.

Documents are tokenised once; only those longer than a sequence are cut, into full pieces behind a
first one that holds the rest. Full pieces are sequences by themselves. The others arrive one by one:
each goes to the open bin that it leaves least room in, found as the lowest set bit of a bitset that
says at which amounts of free space there are open bins. When all bins that may be open are, the
fullest closes. A task packs so many pieces that its last open bins do not count, from a written
table of their lengths, which a lost executor's tasks read again.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.bytepair import BytePairs
from voltide.llm.common import materialise, slices

#: Pieces that one task packs, about; a task's open bins are some thousandths of its sequences.
TASK_PIECES = 400_000
#: Pieces that arrive together, the longest first.
ARRIVALS = 4096


class Bins:
    """At most `most` open bins of `room` each; `add` gives the bin of an item and its offset there."""

    def __init__(self, room: int, most: int):
        self.room, self.most = room, most
        self.bits, self.open, self.opened = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(room)]  # open bins by free space

    def add(self, size: int) -> tuple[int, int]:
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.room, self.opened
            self.opened += 1
        left = free - size
        if left:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(bin_)
            self.open += 1
        return bin_, self.room - free

    def _take(self, free: int) -> int:
        """The bin opened last of those with this free space; it is open no more."""
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_


PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The columns of `docs` without its text, and per piece: piece (from 0), start (ids of its document
    before it), length, ids_crc32 (of the ids as little-endian 32-bit numbers) and, with `with_ids`,
    ids. Those five must not be columns of `docs`.

    A document is its text's ids and `end`; a null text counts as empty, so every row has one piece at
    least. Rows are documents of their own, whether or not they are equal.
    """
    clash = {*PIECES.names, "ids"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns of documents and of pieces have the same name: {sorted(clash)}")
    source = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    kept = [c for c in docs.columns if c != text]
    fields = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES
    kind = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "array<int>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), *(f"{n} {kind[n]}" for n in fields.names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairs(source.value, specials=True)
        for batch in slices(batches, text):
            out: dict[str, list] = {n: [] for n in fields.names}
            of: list[int] = []
            for row, t in enumerate(batch.column(text).to_pylist()):
                ids = encoder.encode(t or "")
                ids.append(end)
                n, at = len(ids), 0
                while at < n:
                    part = ids[at : at + ((n - at) % room or room)]
                    of.append(row)
                    for name, value in (("piece", -(-at // room)), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(_little(part))), *((("ids", part),) if with_ids else ())):
                        out[name].append(value)
                    at += len(part)
            rows = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)
            same = batch.select(kept).take(pa.array(of, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*same.columns, *rows.columns], names=[*kept, *fields.names])

    return docs.mapInArrow(run, schema)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = ids[:]
        ids.byteswap()
    return ids.tobytes()


def placed(cut: DataFrame, room: int = 1024, most_open: int = 4096, task_pieces: int = TASK_PIECES) -> DataFrame:
    """The rows of `cut`, a written table with a column `length` from 1 to `room`, with sequence_id and
    offset: the sequence that the row is in, and where. Sequences have no gaps; ids are unique. The
    table is read by as many tasks as it has `task_pieces` rows; nothing is shuffled. Of every
    ARRIVALS rows the longest come first: what fits into the smallest gaps comes while they are open."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = Bins(room, most_open), TaskContext.get().partitionId() << 40
        for whole in batches:
            for a in range(0, whole.num_rows, ARRIVALS):
                batch = whole.slice(a, ARRIVALS)
                sizes = batch.column("length").to_pylist()
                ids, at = [0] * len(sizes), [0] * len(sizes)
                for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
                    ids[i], at[i] = bins.add(sizes[i])
                ids = [base + b for b in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, type=pa.int64()), pa.array(at, type=pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    tasks = max(1, round(cut.count() / task_pieces))
    return cut.coalesce(tasks).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, most_open: int = 4096, with_ids: bool = False) -> DataFrame:
    """The columns of `pieces`, sequence_id and offset of every piece of every document of `docs`."""
    return placed(materialise(pieces(docs, tokenizer, room, end, with_ids=with_ids)), room, most_open)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the lengths of its pieces in order, of what `pack` gives with ids: the
    training sequences themselves. A sequence has no more pieces than it has tokens."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("all"))
    return whole.select("sequence_id", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"), F.transform("all", lambda x: x["length"]).alias("lengths"))


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (see `pack`)."""
    return pack(docs.select("doc_id", "text"), tokenizer)
