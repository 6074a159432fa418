"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of a suitable model crosses from an ordinary character to a white space marker or holds a
newline, so a marked text can be cut there and its chunks segmented one by one. Each text is cut
into chunks, each distinct chunk that the task has not met yet is segmented once, and the ids are
joined back by position. The table lives as long as the task and is emptied at a fixed size, so
memory is bounded and a lost executor costs nothing but its tasks.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import annotate

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")
RESULT = T.StructType(
    [
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class ChunkTable:
    """Ids (as a text of decimals) and decoded text of every distinct chunk met so far."""

    def __init__(self, model: bytes, most: int, longest: int = 48):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.most, self.longest = most, longest
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.long: list[str] = []  # chunks that are kept for their own text alone
        self.newline = self.sp.encode("\n")[-1]
        for i in range(len(self.sp)):
            piece = self.sp.id_to_piece(i)
            if "\n" in piece or re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError(f"pieces of this model cross chunks: {piece!r}")

    def learn(self, chunks: set[str]) -> None:
        """Segment new chunks, all in one text with newlines between them, which never join. The
        library puts a marker of its own before that text; it stands apart as the first id."""
        missing = [c for c in chunks if c not in self.ids]
        new = [c for c in missing if c[0] != "\n"]
        if new:
            ids = self.sp.encode("\n" + "\n".join(new))
            found = " ".join(map(str, ids)).split(f" {self.newline} ")[1:]
            texts = self.sp.decode(ids).split("\n")[1:]
            self.ids.update(zip(new, found, strict=True))
            self.text.update(zip(new, texts, strict=True))
        for c in (c for c in missing if c[0] == "\n"):
            self.ids[c], self.text[c] = " ".join([str(self.newline)] * len(c)), c
            new.append(c)
        self.long += [c for c in new if len(c) > self.longest]

    def forget(self) -> None:
        if len(self.ids) > self.most:
            self.ids.clear()
            self.text.clear()
        else:
            for c in self.long:
                self.ids.pop(c, None)
                self.text.pop(c, None)
        self.long.clear()

    def encode(self, text: str | None, end: int | None) -> tuple[str, str]:
        """The ids of one text, as decimals joined by a space, and what they decode to."""
        cut = CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
        self.learn(set(cut))
        ids = " ".join(map(self.ids.__getitem__, cut))
        back = "".join(map(self.text.__getitem__, cut))[1:]
        if end is not None:
            ids = f"{ids} {end}" if ids else str(end)
        self.forget()
        return ids, back


def encode(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    add_end: bool = True,
    most_chunks: int = 100_000,
    fields: tuple[str, ...] = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"),
) -> tuple[DataFrame, str]:
    """Add a struct column with the named `fields`: ids (decimals joined by one space), the decoded
    text, the number of ids and both digests. Returns the frame and that column's name.

    A null text counts as empty: it has the end id alone and decodes to nothing. Texts are taken
    whole; a chunk may be as long as its text. `most_chunks` bounds the table between batches.
    Other columns, whatever their names, stay; rows are never dropped, merged or reordered.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = T.StructType([f for f in RESULT.fields if f.name in fields])

    def make():
        chunks = ChunkTable(model.value, most_chunks)
        end = chunks.sp.eos_id() if add_end else None

        def sha(value):
            return hashlib.sha256(value.encode()).hexdigest()

        def values(text):
            ids, back = chunks.encode(text, end)
            found = {
                "ids": lambda: ids,
                "decoded": lambda: back,
                "n_tokens": lambda: ids.count(" ") + 1 if ids else 0,
                "ids_sha256": lambda: sha(ids),
                "decoded_sha256": lambda: sha(back),
            }
            return [found[f]() for f in fields]

        def score(texts):
            rows = []
            for i, t in enumerate(texts):  # copies that stand together are segmented once
                rows.append(rows[-1] if i and t == texts[i - 1] else values(t))
            return dict(zip(fields, map(list, zip(*rows, strict=True)), strict=True)) if rows else {f: [] for f in fields}

        return score

    return annotate(docs, text, kind, make)


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (see `encode`)."""
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    df, name = encode(docs.select("doc_id", "text"), model_path, fields=fields)
    return df.select("doc_id", *(F.col(f"{name}.{f}").alias(f) for f in fields))
