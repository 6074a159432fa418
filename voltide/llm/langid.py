"""Nearest-centroid language identification.

A text becomes a TF-IDF vector of hashed character n-grams (one to three characters of lower-cased
words, counts damped by log(1 + n)), of length one. Every language has several centroids, found by
spherical k-means; the language of the nearest centroid by cosine is predicted, and a text that is
much farther away than the language's own texts of its length is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import annotate, fraction, held_out, materialise

DIMS = 4096
#: Languages up to which their rates are sent to all tasks.
MOST_SENT = 100_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter()[codes]
    if not letters.any():
        return None
    c = np.where(letters, codes, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    one = c * np.uint32(2654435761)
    two = one[:-1] ^ (c[1:] * np.uint32(2246822519))
    three = (two[:-1] * np.uint32(668265263)) ^ (c[2:] * np.uint32(374761393))
    grams = np.concatenate((one[c != 32], two, three * np.uint32(2654435769)))
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)


def weigh(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def _bucket(n: np.ndarray) -> int:
    return min(int(np.log2(max(n.sum(), 1))), 15)


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the text that is farthest from those chosen so far."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c


def fit(docs: DataFrame, per_language: int = 400, k: int = 4) -> dict:
    """Learn from text and non-null lang of the documents that are not held out.

    About `per_language` different texts of each language are used, chosen by a hash of the text: the
    documented bound of this fit. Every language takes part with one text at least, that of the
    smallest hash, however often its texts are repeated. Returns arrays (dims, idf,
    centroids, their languages, the least cosine by text length) that grow with the languages alone.
    """
    rows = docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out("doc_id"), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = rows.withColumn("draw", fraction("text", "langid"))
    different = hashed.select("lang", "draw").distinct()  # numbers alone are shuffled
    rate = materialise(different.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("rate"), F.min("draw").alias("first")))
    sent = F.broadcast(rate) if rate.count() <= MOST_SENT else rate
    drawn = hashed.join(sent, "lang").where("draw < rate or draw = first").select("lang", "text").dropDuplicates()

    def vectors(batches):
        for b in batches:
            got = [(x, n) for x, n in ((x, counts(t)) for x, t in zip(b["lang"], b["text"], strict=True)) if n is not None]
            if got:
                yield pd.DataFrame({"lang": [x for x, _ in got], "n": [n.astype(np.int32) for _, n in got]})

    sample = materialise(drawn.mapInPandas(vectors, "lang string, n array<int>"))

    def present(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"rows": [len(b)], "df": [(np.stack(b["n"]) > 0).sum(0)]})

    total, df = 0, np.zeros(DIMS)
    for r in sample.mapInPandas(present, "rows long, df array<long>").toLocalIterator():
        total, df = total + r["rows"], df + np.array(r["df"])
    if not total:
        return {"langs": [], "idf": np.ones(DIMS), "centroids": np.zeros((0, DIMS), np.float32), "owner": np.zeros(0, int), "least": {}}
    idf = np.log((1 + total) / (1 + df)) + 1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.stack(pdf["n"])
        x = np.stack([weigh(v, idf) for v in n])
        c = _centroids(x, k)
        best, at = (x @ c.T).max(1), np.array([_bucket(v) for v in n])
        least = [float(np.quantile(best[at == b], 0.01)) if (at == b).sum() >= 5 else -1.0 for b in range(16)]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": list(c.astype(np.float64)), "least": [least] * len(c)})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, c array<double>, least array<double>").orderBy("lang", "c").collect()
    langs = sorted({r["lang"] for r in found})
    return {
        "langs": langs,
        "idf": idf,
        "centroids": np.array([r["c"] for r in found], np.float32).reshape(-1, DIMS),
        "owner": np.array([langs.index(r["lang"]) for r in found], int),
        "least": {r["lang"]: r["least"] for r in found},
    }


KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identify(docs: DataFrame, model: dict, text: str = "text", slack: float = 0.5) -> tuple[DataFrame, str]:
    """Add a struct column (lang_pred, score, rejected); returns the frame and that column's name.

    The score is the cosine to the nearest centroid, 0 to 1; ties go to the language first by code
    point. A text that is null or has no letter is `und`, scored 0 and rejected. Any other text is
    rejected if its cosine is under `slack` times the first percentile of the learned texts of its
    language and length class (the nearest shorter class with a figure; none: not rejected).
    Texts are read whole; all columns and rows of `docs` stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        idf, c, owner, langs, least = m["idf"], m["centroids"], m["owner"], m["langs"], m["least"]

        def one(t):
            n = counts(t)
            if n is None or not langs:
                return "und", 0.0, True
            cos = c @ weigh(n, idf)
            j = int(cos.argmax())
            lang = langs[owner[j]]
            bars = [x for x in least[lang][: _bucket(n) + 1] if x >= 0]
            return lang, float(min(max(cos[j], 0), 1)), bool(bars and cos[j] < slack * bars[-1])

        def score(texts):
            got = [one(t) for t in texts]
            return {f.name: [g[i] for g in got] for i, f in enumerate(KIND.fields)}

        return score

    return annotate(docs, text, KIND, make)


def predictions(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict all of them."""
    df, name = identify(docs.select("doc_id", "text"), fit(docs))
    return df.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), *(F.col(f"{name}.{f.name}").alias(f.name) for f in KIND.fields))
