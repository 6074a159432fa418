"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, drops accents, maps look-alike letters and digit substitutions to one letter
(so `i`, `l`, `1` and `!` meet) and turns everything else into spaces. Lexicon entries are whole
words and word beginnings, learned with their log-odds from labelled documents; phrases in which an
entry is harmless cancel it. The sum of the weights and its ratio to the length give the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import annotate, fraction, held_out, materialise

# Letters that look alike, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіѕјԁɡαβεικνορτυχω", "abekmhopctyxisjdgabeikvoptuxw", strict=True))
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "l", "i": "l", "|": "l"}


class _Fold(dict):
    """What each character becomes, found when it is first met."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code).lower())
        c = "".join(HOMOGLYPHS.get(x, x) for x in c if not unicodedata.combining(x))
        c = "".join(SUBSTITUTES.get(x, x if x.isalpha() else " ") for x in c)
        if chr(code) in "​‌‍­﻿":
            c = ""
        self[code] = c
        return c


_FOLD = _Fold()


def fold(text: str | None) -> str:
    return (text or "").translate(_FOLD)


def entries(token: str, shortest: int = 4, longest: int = 8) -> Iterable[str]:
    """What a token can match: itself between spaces, and its beginnings after a space."""
    yield f" {token} "
    for n in range(shortest, min(longest, len(token)) + 1):
        yield f" {token[:n]}"


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: Iterable[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for e, w in lexicon.items():
            self.automaton.add_word(e, (len(e), w))
        for e in exceptions:
            self.automaton.add_word(e, (len(e), None))
        self.automaton.make_automaton()
        self.any = len(self.automaton) > 0

    def weights(self, folded: str) -> dict[int, float]:
        """The weight of the token at each start; one in an exception phrase has none."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if self.any:
            for end, (n, w) in self.automaton.iter(f" {folded} "):
                at = end - n + 1
                if w is None:
                    spared.append((at, end))
                else:
                    found[at] = max(w, found.get(at, w))
        if not spared:
            return found
        spared.sort()
        kept, i, reach = {}, 0, -1
        for a in sorted(found):  # both in page order: one sweep
            while i < len(spared) and spared[i][0] <= a:
                reach = max(reach, spared[i][1])
                i += 1
            if a >= reach:
                kept[a] = found[a]
        return kept


def features(folded: str, matcher: Matcher) -> tuple[float, float, float]:
    total = sum(matcher.weights(folded).values())
    return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / (len(folded.split()) + 10)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * b)
    return b


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, least_share: float = 0.006, least_weight: float = 2.5) -> dict:
    """Learn lexicon, exception phrases and calibration from labelled, not held-out documents.

    About `max_rows` labelled documents at most are used, chosen by a hash of doc_id: the documented
    bound of this fit. A text counts as often as there are rows with it, but once for exception
    phrases. Without any entry the score is the share of toxic rows, a little under a half for equal
    shares. An entry is in `least_share` of the toxic ones at least, which bounds their
    number by the length of the texts. Labels that are null or given twice with different values are
    not used.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), "toxic").where(F.col("toxic").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(True)))
    n = known.count()
    known = known.where(fraction("id", "toxicity") < min(1.0, max_rows / max(n, 1)))
    known = known.groupBy("id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z").drop("z")
    rows = materialise(
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (fraction("doc_id", "toxicity") < min(1.0, max_rows / max(n, 1))))
        .join(known, F.col("doc_id") == F.col("id"))
        .groupBy("text", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return {"lexicon": {}, "exceptions": [], "b": np.array([-5.0, 0.0, 0.0])}

    def count(keep: set[str] | None):
        def run(batches):
            for b in batches:
                seen: Counter[str] = Counter()
                for t, n in zip(b["text"], b["n"], strict=True):
                    for e in {e for w in set(fold(t).split()) for e in entries(w)}:
                        if keep is None or e in keep:
                            seen[e] += int(n)
                if seen:
                    yield pd.DataFrame({"entry": list(seen), "n": list(seen.values())})

        return run

    kind = "entry string, n long"
    often = rows.where("y = 1").mapInPandas(count(None), kind).groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, least_share * toxic))
    often = {r["entry"]: r["n"] for r in often.collect()}
    keep = set(often)
    there = {r["entry"]: r["n"] for r in rows.where("y = 0").mapInPandas(count(keep), kind).groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    weight = {e: float(np.log((k + 0.5) / (toxic + 1)) - np.log((there.get(e, 0) + 0.5) / (clean + 1))) for e, k in often.items()}
    best = sorted((e for e in weight if weight[e] >= least_weight), key=lambda e: (-weight[e], e))
    lexicon = {e: weight[e] for e in best}
    # an entry says nothing that its own beginning does not say as surely
    lexicon = {e: w for e, w in lexicon.items() if not any(lexicon.get(e[:m], -1) >= w - 0.3 for m in range(5, len(e)))}
    if not lexicon:
        return {"lexicon": {}, "exceptions": [], "b": np.array([np.log((toxic + 0.5) / (clean + 1)), 0.0, 0.0])}

    def phrases(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for t, y in zip(b["text"], b["y"], strict=True):
                folded = fold(t)
                found = matcher.weights(folded)  # by the place of the space before the word
                words, own = list(re.finditer(r"\S+", f" {folded} ")) if found else [], set()
                for i, w in enumerate(words):
                    if w.start() - 1 in found:
                        own |= {f" {words[j][0]} {words[j + 1][0]} " for j in (i - 1, i) if 0 <= j < len(words) - 1}
                seen.update((p, int(y)) for p in own)
            if seen:
                yield pd.DataFrame({"entry": [p for p, _ in seen], "y": [y for _, y in seen], "n": list(seen.values())})

    harmless = rows.mapInPandas(phrases, "entry string, y int, n long").groupBy("entry").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"))
    exceptions = [r["entry"] for r in harmless.where("c >= 5 and t = 0").orderBy("entry").collect()]

    def measured(batches):
        matcher = Matcher(lexicon, exceptions)
        for b in batches:
            if not len(b):
                continue
            yield pd.DataFrame([(*features(fold(t), matcher)[1:], float(y), float(n)) for t, y, n in zip(b["text"], b["y"], b["n"], strict=True)], columns=["u", "v", "y", "n"])

    got = np.array([tuple(r) for r in rows.mapInPandas(measured, "u double, v double, y double, n double").collect()])
    x = np.column_stack((np.ones(len(got)), got[:, :2]))
    order = np.lexsort(x.T)
    return {"lexicon": lexicon, "exceptions": exceptions, "b": _logistic(x[order], got[order, 2], got[order, 3])}


KIND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def assess(docs: DataFrame, model: dict, text: str = "text") -> tuple[DataFrame, str]:
    """Add a struct column (score, predicted); returns the frame and that column's name.

    Whole texts are scored; null and empty ones get the score of a text without any match. Nothing
    but the text is read; all columns and rows of `docs` stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        matcher, b = Matcher(shared.value["lexicon"], shared.value["exceptions"]), shared.value["b"]

        def score(texts):
            z = [float(np.dot(b, features(fold(t), matcher))) for t in texts]
            p = [1 / (1 + float(np.exp(-min(max(v, -30), 30)))) for v in z]
            return {"score": p, "predicted": [int(v >= 0.5) for v in p]}

        return score

    return annotate(docs, text, KIND, make)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out and score all documents."""
    df, name = assess(docs.select("doc_id", "text"), fit(docs, labels))
    return df.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col(f"{name}.score").alias("score"), F.col(f"{name}.predicted").alias("predicted"))
