"""Packing, periodic runs and token alignment against brute force and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import alignment, packing, queries, runs
from voltide.llm.bytepair import BytePairs

DIR = "/root/testdata/sf0.01"
JSON, MODEL = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path()
MARKS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "!", "'s", "<|endoftext|>", "</s>", "漢", "🙂", "▁", "the ", "tokenization ", "\0", "\x85", "<0x41>", "　"]


def library(specials):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(JSON)
    out.encode_special_tokens = not specials
    return out


def hostile(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(MARKS) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("specials", [True, False])
def test_byte_pairs_are_the_librarys(spark, specials):
    with open(JSON, encoding="utf-8") as f:
        own = BytePairs(f.read(), specials)
    texts = hostile(1, 5000) + [r[0] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    want = library(specials).encode_batch(texts, add_special_tokens=False)
    assert [list(own.encode(t)) for t in texts] == [w.ids for w in want]


# ---------------------------------------------------------------- packing


def fixture(spark, texts):
    """Ids that are null or repeated, and columns whose names clash with the operators' own."""
    rows = [(None if i % 7 == 3 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, result string, found int").repartition(3)


def check_packing(rows, texts):
    """Pieces tile their documents, sequences have no gaps, and there are few of them."""
    tok = library(True)
    want, total = Counter(), 0
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        total += len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), -(-total // 1024)


def test_packing_whole_table(spark):
    rows = queries.op11_best_fit_packing(spark, DIR).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got, least = check_packing(rows, texts)
    assert got <= 1.005 * least + 1


def test_packing_odd_rows(spark):
    texts = [*hostile(2, 60), None, "", " ", "word " * 5000, "a" * 9000, *["same text"] * 40]
    docs = fixture(spark, texts)
    rows = packing.packed_documents(docs, JSON).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.packed_documents(docs.limit(0), JSON).count() == 0
    with pytest.raises(ValueError, match="same name"):
        packing.pieces(docs.withColumn("Length", F.lit(1)), JSON)


def test_sequences_are_the_tokens(spark):
    docs = fixture(spark, [*hostile(3, 50), "word " * 3000])
    packed = packing.pack(docs, JSON, with_ids=True)
    found = packing.sequences(packed).collect()
    tok = library(True)
    want = Counter(i for r in docs.collect() for i in [*tok.encode(r["text"], add_special_tokens=False).ids, 2])
    assert Counter(i for r in found for i in r["ids"]) == want
    assert all(sum(r["lengths"]) == len(r["ids"]) <= 1024 for r in found)
    assert {"result", "found"} <= set(packed.columns)


def test_bins_take_the_fullest_and_close_it():
    bins = packing.Bins(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 5, 4, 9)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (3, 0)]
    # bins 2 (free 5) and 3 (free 1) are open; a further one closes bin 3
    assert bins.add(6) == (4, 0) and bins.add(1) == (4, 6) and bins.open == 2


# ---------------------------------------------------------------- runs


def plain_lyndon(x):
    out = []
    for i, c in enumerate(x):
        end = next((e for e in range(i, len(x)) if x[e] == 0), len(x))
        j = i + 1
        while c and j < end and x[j:end] > x[i:end]:
            j += 1
        out.append(j - i if c else 0)
    return out


def plain_runs(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            own = w[i : i + n]
            if j > i and n >= max(least, times * q) and not any(own[d:] == own[: n - d] for d in range(1, q)):
                out.add((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(r):
    out = []
    while len(out) < r.randint(0, 70):
        out += [r.choice("ab") for _ in range(r.randint(1, 5))] * r.randint(1, 7) if r.random() < 0.5 else [r.choice("abc")]
    return out


def test_lyndon_arrays():
    r = random.Random(0)
    for _ in range(3000):
        top = r.randint(1, 4)
        x = [r.randint(0, top) for _ in range(r.randint(1, 24))]
        x = (x[: r.randint(1, 4)] * 8)[: r.randint(1, 30)] + x
        assert runs.lyndon(x, top + 1) == plain_lyndon(x)


def plain_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if plant and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def test_runs_odd_rows(spark):
    r = random.Random(4)
    texts = [" ".join(periodic(r)) for _ in range(300)] + [None, "", " \n", "x " * 3000, "a b c d " * 40, "  a\x1cb " * 9]
    docs = fixture(spark, texts)
    want = Counter(plain_row(d, t) for d, t in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, runs.run_digests(docs).collect())) == want
    df, name = runs.runs(docs)
    assert name == "_found" and {"result", "found"} <= set(df.columns)
    for row in df.collect():
        want = plain_row(row["doc_id"], row["text"], plant=False)
        assert hashlib.sha256(row[name]["collapsed"].encode()).hexdigest() == want[-1] and len(row[name]["runs"]) == want[1]
    assert runs.run_digests(docs.limit(0)).count() == 0


def test_runs_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 4000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, DIR).collect()}
    assert len(got) == 1000 and sum(r[1] > 0 for r in got.values()) > 50
    for d, t in docs:
        assert got[d] == plain_row(d, t)


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    """Per text: n_a, n_b, n_groups, n_links, groups and links, by comparing all ranges."""
    import sentencepiece

    tok, sp = library(False), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(JSON, encoding="utf-8") as f:
        known = BytePairs(f.read(), False).tokens
    out = []
    for t in texts:
        want = (" " + (t or "")).encode()
        sides = []
        for ids, of in ((tok.encode(" " + (t or ""), add_special_tokens=False).ids, known.get), (sp.encode(t or ""), lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())):
            spans, at = [], 0
            for i in ids:
                spans.append((at, at := at + len(of(i)), i))
            sides.append((spans, b"".join(map(of, ids))))
        (a, ja), (b, jb) = sides
        if not t or ja != want or jb != want:
            out.append((0, 0, 0, 0, "", []))
            continue
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, start = [], 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            groups.append("|".join(",".join(str(x[2]) for x in side if start < x[1] <= end) for side in (a, b)))
            start = end
        out.append((len(a), len(b), len(groups), len(links), ";".join(groups), links))
    return out


@pytest.mark.parametrize("most_sent", [alignment.MOST_SENT, 0])
def test_alignment_odd_rows(spark, most_sent):
    texts = [*hostile(5, 250), None, "", " ", "hello world", *["an international tokenization"] * 30]
    docs = fixture(spark, texts)
    rows = docs.select("doc_id", "text").collect()
    found = plain_alignment([t for _, t in rows])
    counts = Counter(p for f in found for p in set(f[5]))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    want = Counter()
    for (d, _), (n_a, n_b, n_groups, n_links, groups, links) in zip(rows, found, strict=True):
        sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        want[d, n_a, n_b, n_groups, n_links, sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), sha] += 1
    assert Counter(map(tuple, alignment.link_statistics(docs, JSON, MODEL, most_sent).collect())) == want
    assert alignment.link_statistics(docs.limit(0), JSON, MODEL, most_sent).count() == 0


def test_alignment_whole_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, DIR).collect()}
    other = {r["doc_id"]: r for r in alignment.link_statistics(spark.read.parquet(f"{DIR}/documents.parquet"), JSON, MODEL, 0).collect()}
    assert got == other and len(got) == 1000
    short = [r for r in docs if len(r["text"] or "") < 700]
    for r, f in zip(short, plain_alignment([r["text"] for r in short]), strict=True):
        assert tuple(got[r["doc_id"]])[1:5] == f[:4]
