"""The training-data operators against brute force on small fixtures."""

import random
from collections import Counter
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm import extraction, langid, licences, mixing, neardup, pieces, quality, sharding, topk, toxicity
from voltide.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("result", T.StringType()))])
ODD = [
    (1, None, None, None, "x"), (2, "", "en", "a", "x"), (3, " \n\t ", "en", None, "x"), (4, "one", None, "a", "x"), (5, "one", None, "a", "x"), (5, "one", None, "a", "x"),
    (6, "a b c d e f g h " * 60 + "end", "en", "b", None), (7, "word " * 3000, "en", "b", None), (8, "Ünï côdé 🤗 ▁x\n\nline\nline", "fr", "b", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w = words(t)
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(x for i in at for x in range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, docs, odd):
    for df in (docs.select("doc_id", "text", "lang", "source"), odd):
        got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.rules(df).collect())
        assert got == sorted((r["doc_id"], *base(r["text"])) for r in df.collect())


def test_quality_keeps_good_documents(spark, docs, labels):
    got = quality.rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.3


def test_quality_rejects_a_third_of_copies(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    junk = " ".join(f"{word()}{r.choice('#$%&|') * 3}" for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(r.randint(60, 200))), "en", "a") for i in range(300)] + [(1000 + i, junk, "en", "a") for i in range(150)]
    got = quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(x["base_failed"] for x in got) and not any(x["kept"] for x in got if x["doc_id"] >= 1000)
    assert sum(x["kept"] for x in got if x["doc_id"] < 1000) >= 297


def test_tokens_match_the_library(spark, docs, odd):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for df in (docs.limit(150), odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted((r["doc_id"], len(i := sp.encode(r["text"] or "", add_eos=True)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for r in rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, pieces.token_digests(frame, tokenizer_path()).collect())) == want


def test_language_held_out(spark, docs):
    p = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd(spark, odd):
    got = {r["doc_id"]: r for r in langid.predictions(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[8]["lang_pred"] != "und"


def test_toxicity_held_out(spark, docs, labels):
    p = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert p.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_folding_and_exceptions():
    assert toxicity.fold("lD10t") == toxicity.fold("idiot") == toxicity.fold("ідіот".replace("д", "d").replace("т", "t"))
    m = toxicity.Matcher({" ldlot ": 5.0}, [" ldlot box "])
    assert m.weights("an ldlot here") and not m.weights("the ldlot box")


def test_neardup_brute_force(spark, docs, odd):
    for df, k in ((docs.limit(300), 2), (odd, 5)):
        rows = df.select("doc_id", "text").collect()
        sets = {}
        for r in rows:
            w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((r["doc_id"], len(sets[r["doc_id"]]), find(r["doc_id"])) for r in rows)


def test_mixing(spark, docs, odd):
    for df in (docs, odd):
        rows = mixing.mix(df).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
        assert len({r["doc_id"] for r in rows}) == df.select("doc_id").distinct().count()
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
        again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(3)).collect()}
        assert all(again[r["doc_id"]] == r["taken"] for r in rows)
    by = {}
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        t = by.setdefault(r["source"], [0, r["target"], 0])
        t[0] += r["taken"]
        t[2] = max(t[2], r["size"])
    assert all(abs(x - t) <= big for x, t, big in by.values())


def test_mixing_null_and_repeated_ids(spark):
    r = random.Random(1)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "w " * r.randint(1, 9), "x", s) for s in "abc" for i in range(600)]
    by, sizes = {}, []
    for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        t = by.setdefault((x["target"], x["source_size"]), [0, 0])
        t[0] += x["taken"]
        t[1] = max(t[1], x["size"])
        sizes.append(x["size"])
    assert len(sizes) == len(rows) and all(abs(x - target) <= big for (target, _), (x, big) in by.items())


def test_pipeline_stages_null_and_repeated_ids(spark):
    import corpus_pipeline

    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3]), (2, texts[2])]
    docs = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(x["text"] for x in kept) == texts
    got = neardup.near_duplicates(docs).collect()
    assert sorted(str((x["doc_id"], x["component_id"])) for x in got) == sorted(map(str, [(None, None)] * 2 + [(1, 1)] * 3 + [(2, 1)])) and sum(x["kept"] for x in got) == 4
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert len(mixed) == 9  # one source: its target is 1.5 times its words, in documents of one size


def test_topk_ties_and_odd_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(8)]) for i in range(400)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=150, query_rows=3).collect()
    x = np.floor(256 * np.array([v for _, v in rows[:400]])).astype(int)
    want = [(q, n + 1, int(c), int(s[c])) for q in range(0, 400, 50) for s in [x @ x[q]] for n, c in enumerate([c for c in np.lexsort((np.arange(400), -s)) if c != q][:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_repeated_rows_missing_ids_and_other_lengths(spark):
    """Every row is a candidate and every marked row a query of its own."""
    r = random.Random(8)
    rows = [(i // 2, [r.choice([-0.5, 0.25, 0.9]) for _ in range(4)]) for i in range(120)]
    rows += [(0, rows[0][1]), (50, rows[100][1])] + [(None, [0.9] * 4)] * 3 + [(100, [0.9] * 4), (100, [0.5] * 3), (3, [0.9] * 3)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, KEY int").repartition(4)
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=40, query_rows=3).collect()))
    want = Counter()
    for n, (q, v) in enumerate(rows):
        if q is not None and q % 50 == 0:
            x = np.floor(256 * np.array(v)).astype(int)
            scored = [(-int(np.floor(256 * np.array(w)).astype(int) @ x), i is None, i or 0, i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v)]
            want.update((q, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:5], 1))
    assert got == want


def test_extraction():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy it now and be happy with all of it.</div><article><h1>Head &amp; line</h1><p>One <b>two<br>three</p><p>End.</article><div class=comments><p>The best of all.</p></div><footer>&copy; me</footer></body>"
    assert extraction.main_text(page) == "Head & line\n\nOne two three\n\nEnd."
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<p") == ""


def test_extraction_other_languages_and_adverts():
    russian = "Вчера в городе прошёл большой праздник, на который собрались жители всех районов и гости из соседних областей. " * 3
    chinese = "昨天城里举行了盛大的节日活动，各区居民和来自邻近地区的客人都参加了这次活动，气氛非常热烈。" * 4
    polish = "Wczoraj odbyło się wielkie święto, podczas którego zebrali się mieszkańcy wszystkich dzielnic oraz goście. " * 3
    for text in (russian, chinese, polish):
        assert extraction.main_text(f"<body><nav>Menu</nav><div><p>{text}</p></div></body>") == text.strip()
    english = "The house on the hill was built for the family that had come to the town from the north. " * 3
    advert = "Megasale! Brandnew sneakers, handbags, watches, sunglasses: discount prices, free shipping, limited stock, order today!"
    assert extraction.main_text(f"<article><p>{english}</p><p>{advert}</p><p>{english}</p></article>") == f"{english.strip()}\n\n{english.strip()}"


def test_licences(spark):
    texts = [licences.MIT.upper(), "Copyright (c) 2020 Someone\n" + licences.ISC.replace(",", " ,"), "prose\nReleased under the MIT License.", None, ""]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licence"] for r in got] == ["MIT", "ISC", None, None, None] and got[2]["notices"] == "MIT"


def test_licences_full_texts_headers_and_reserved_rights(spark):
    from pathlib import Path

    files = sorted((Path(licences.__file__).parent / "licence_texts").glob("*.txt"))
    texts = [(p.stem, "Copyright 2020 Someone\n\n" + re.sub(r"\s+", " ", p.read_text()).replace(". ", ".\n# ")) for p in files if p.stem.startswith(("BSD", "Unl"))]
    texts += [(p.stem, p.read_text().replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 A. Body")) for p in files]
    got = licences.scan(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert len(got) == len(texts) and all(r["licence"] == r["doc_id"] for r in got), [(r["doc_id"], r["licence"]) for r in got if r["licence"] != r["doc_id"]]
    lines = [
        ("prose\nAll rights reserved.\nprose", licences.RESERVED), ("© 2019 A. Body. All Rights Reserved", licences.RESERVED), ("# SPDX-License-Identifier: MPL-2.0\ncode", "MPL-2.0"), ("All rights are reserved for lunch.", ""),
        ("/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is\n */\nx = 1", "GPL-3.0"),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    assert [r["notices"] for r in licences.scan(frame).orderBy("doc_id").collect()] == [n for _, n in lines]
    one = licences.scan(frame, known=[("X", "prose"), ("Y", "Prose!")]).orderBy("doc_id").collect()
    assert [r["notices"] for r in one] == ["X,Y", "", "", "", ""]
    assert licences.scan(frame, known=[]).count() == len(lines)


def test_sharding_moves_little(spark, odd):
    names = [f"s{i}" for i in range(16)]
    a, b = sharding.fill(names), sharding.fill(names[:-1])
    assert max(map(a.count, range(16))) - min(map(a.count, range(16))) <= 1
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 15) < 0.15 * len(a)
    assert sharding.assign(odd, "doc_id", names).count() == len(ODD)


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    for got in (quality.rules(none), langid.predictions(none), toxicity.scores(none, labels.limit(0)), neardup.near_duplicates(none), mixing.mix(none), pieces.token_digests(none, tokenizer_path()), licences.scan(none), sharding.assign(none, "doc_id", ["a"])):
        assert got.count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    assert extraction.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
