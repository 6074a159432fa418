"""The learned operators against plain versions, and on repeated rows."""

import random

import numpy as np

from voltide.llm import common, langid, pieces, queries, toxicity

DIR = "/root/testdata/sf0.01"


def learned_ids(n):
    import zlib

    return [i for i in range(3 * n) if zlib.crc32(str(i).encode()) % 5][:n]


def test_every_language_is_learned(spark):
    texts = ["uno dos tres cuatro", "cinco seis siete", "ocho nueve diez", "once doce trece catorce"]
    rows = [(i, texts[i % 4], "yy") for i in learned_ids(4000)] + [(100_000 + i, f"one two three number {i}", "xx") for i in learned_ids(500)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["xx", "yy"]
    got = langid.identify(spark.createDataFrame([(1, "cinco seis siete")], "doc_id long, text string"), model)[0].first()
    assert got["result"]["lang_pred"] == "yy" and got["result"]["score"] > 0.99


def test_nearest_centroid_is_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), model)[0].collect()}
    for doc_id, text in rows:
        n = langid.counts(text)
        if n is None:
            assert got[doc_id]["result"]["lang_pred"] == "und"
            continue
        v = np.log(1 + n) * model["idf"]
        cos = [float((v * c).sum() / np.sqrt((v * v).sum())) for c in model["centroids"].astype(float)]
        best = max(cos)
        assert model["langs"][model["owner"][cos.index(best)]] == got[doc_id]["result"]["lang_pred"]
        assert abs(best - got[doc_id]["result"]["score"]) < 1e-5


def test_repeated_labelled_rows(spark):
    ids = learned_ids(80)
    rows = [(i, "you utter gnarfle of a person" if k < 40 else "a calm and kind sentence") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if k < 40 else 0) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, labels).collect()}
    assert got == {i: int(k < 40) for k, i in enumerate(ids)}


def test_without_entries_the_majority_counts(spark):
    ids = learned_ids(60)
    docs = spark.createDataFrame([(i, "the same words") for i in ids], "doc_id long, text string")
    for toxic, want in ((20, 0), (30, 0), (0, 0), (40, 1)):
        labels = spark.createDataFrame([(i, int(k < toxic)) for k, i in enumerate(ids)], "doc_id long, toxic int")
        assert {r["predicted"] for r in toxicity.scores(docs, labels).collect()} == {want}


def naive_weights(folded, lexicon, exceptions):
    """All entries by str.find, all exceptions by str.find."""
    page, found, spared = f" {folded} ", {}, set()
    for e, w in lexicon.items():
        at = page.find(e)
        while at >= 0:
            found[at] = max(w, found.get(at, w))
            at = page.find(e, at + 1)
    for e in exceptions:
        at = page.find(e)
        while at >= 0:
            spared |= set(range(at, at + len(e) - 1))
            at = page.find(e, at + 1)
    return {a: w for a, w in found.items() if a not in spared}


def test_matcher_against_naive(spark):
    r = random.Random(3)
    words = ["ab", "abc", "abcd", "abcde", "b", "cab", "x"]
    for _ in range(400):
        lexicon = {e: r.choice([2.0, 3.0, 4.0]) for w in r.sample(words, 3) for e in r.sample([f" {w} ", f" {w}"], 1)}
        exceptions = [f" {r.choice(words)} {r.choice(words)} " for _ in range(r.randint(0, 3))]
        folded = " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
        assert toxicity.Matcher(lexicon, exceptions).weights(folded) == naive_weights(folded, lexicon, exceptions)
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = {x["doc_id"]: x["result"]["score"] for x in toxicity.assess(docs.select("doc_id", "text"), model)[0].collect()}
    for doc_id, text in docs.select("doc_id", "text").collect()[:300]:
        folded = toxicity.fold(text)
        total = sum(naive_weights(folded, model["lexicon"], model["exceptions"]).values())
        z = model["b"] @ [1.0, np.log1p(total), np.log1p(100 * total / (len(folded.split()) + 10))]
        assert abs(scored[doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_long_neighbours_make_phrases(spark):
    """A word that is harmless behind one long word: the phrase is found whole."""
    ids, long = learned_ids(146), "q" * 90
    text = lambda k: f"gnarfle number {k}" if k < 40 else f"number {k} {long} gnarfle here" if k < 46 else f"number {k} of many"
    docs = spark.createDataFrame([(i, text(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 40)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model["exceptions"] and f" {long} gnarfle " in model["exceptions"]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, labels).collect()}
    assert got == {i: int(k < 40) for k, i in enumerate(ids)}


def test_slices_are_bounded(spark):
    import pyarrow as pa

    texts = ["x" * n for n in (10, 9_000_000, 5, 3_000_000, 2_000_000, 0)] + [None, *["y"] * 3000]
    got = list(common.slices(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), "t"))
    assert [t for b in got for t in b.column("t").to_pylist()] == texts
    assert all(b.num_rows <= common.SLICE and (b.num_rows == 1 or sum(len(t or "") for t in b.column("t").to_pylist()) <= common.SLICE_BYTES) for b in got)


def test_copies_side_by_side_are_segmented_once(spark):
    with open(queries.tokenizer_path(), "rb") as f:
        chunks = pieces.ChunkTable(f.read(), 10)
    for t in ("some words here", "", None, "a" * 100, "\n\n", "many other words that fill the table up to its bound twice"):
        ids, back = chunks.encode(t, 2)
        assert ids == " ".join(map(str, chunks.sp.encode(t or "", add_eos=True))) and back == (t or "")
        assert len(chunks.ids) <= 10 + 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", None, None, "", "a b"])], "doc_id long, text string").coalesce(1)
    assert [r["n_tokens"] for r in pieces.token_digests(docs, queries.tokenizer_path()).orderBy("doc_id").collect()] == [3, 3, 1, 1, 1, 3]
