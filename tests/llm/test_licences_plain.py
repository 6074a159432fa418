"""The licence scan against a line-by-line version with dictionaries."""

import hashlib
from collections import Counter, defaultdict

import regex

from voltide.llm import licences

DIR = "/root/testdata/sf0.01"


def plain(lowered):
    out = regex.sub(r"[^\p{L}\p{N}]+", " ", lowered.replace("&", " and "))
    for a, b in licences.SPELLINGS:
        out = regex.sub(a, b, out)
    return out.strip(" ")


def whole(text):
    return plain(regex.sub(licences.COPYRIGHT, " ", text.lower()))


def part(text):
    return plain(regex.sub(licences.HOLDER, "", text.lower()))


def known(form):
    out = defaultdict(set)
    for i, text in licences.KNOWN:
        if form is part or whole(text):
            out[form(text)].add(i)
    return out


def scanned(rows):
    full, parts = known(whole), known(part)
    for doc_id, text in rows:
        lines = (text or "").split("\n") + [p for p in regex.split(licences.GAP, text or "") if "\n" in p]
        notices = sorted({i for x in lines for i in parts.get(part(x), ())})
        digest = None if text is None else hashlib.sha256(whole(text).encode()).hexdigest()
        licence = None if text is None else ",".join(sorted(full.get(whole(text), ()))) or None
        yield doc_id, digest, licence, ",".join(notices)


def test_scan_is_the_plain_one(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    texts += [None, "", "\n\n", "MIT", "Copyright (c) 2020 A. All rights reserved."] * 2
    texts += [t for _, t in licences.KNOWN[::7]] + [f"words before\n{t}\n\nand behind" for _, t in licences.KNOWN[:40]] + [licences.KNOWN[0][1].upper(), licences.KNOWN[-1][1].replace(" ", " - ")]
    docs = spark.createDataFrame([(None if i % 9 == 4 else i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, LICENCE int").repartition(3)
    rows = docs.select("doc_id", "text").collect()
    got = Counter(map(tuple, licences.scan(docs).collect()))
    assert got == Counter(scanned(rows)) and sum(x[2] is not None for x in got) > 20 and sum(bool(x[3]) for x in got) > 40
