"""License scans by canonical digest.

A text is normalised (case, copyright lines, equivalent spellings, punctuation and white space) and
its digest is joined with the digests of known licence texts. Whole texts are looked up, and every
line and every paragraph, each as a text of its own.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
RESERVED = "LicenseRef-all-rights-reserved"
# One-line notices, and the standard headers or their first paragraphs.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (RESERVED, "All rights reserved."),
    (RESERVED, "Alle Rechte vorbehalten."),
    (RESERVED, "Tous droits réservés."),
    (RESERVED, "Todos los derechos reservados."),
]
GNU = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NAMES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "Unlicense": "The Unlicense"}


def _families() -> list[tuple[str, str]]:
    """The notices that differ by a name or a version alone."""
    out = []
    for i, name, version in GNU:
        for what in ("program", "library", "file", "software"):
            start = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
            out += [(i, f"{start}, either version {version} of the License, or (at your option) any later version."), (i, f"{start}, version {version} of the License.")]
        out.append((i, f"Licensed under the {name}, version {version}."))
    for short, name in CREATIVE.items():
        for version, scope in (("4.0", "International"), ("3.0", "Unported")):
            i = f"CC-{short}-{version}"
            out += [(i, f"Licensed under CC {short} {version}."), (i, f"This work is licensed under CC {short} {version}."), (i, f"This work is licensed under a Creative Commons {name} {version} {scope} License."), (i, f"This work is licensed under the Creative Commons {name} {version} {scope} License.")]
    return out


def _texts() -> list[tuple[str, str]]:
    """The full texts, with and without title, list numbers and the part on how to apply them."""
    files = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    out = []
    for i, text in [("MIT", MIT), ("ISC", ISC), *files.items()]:
        forms = {text, re.split(r"(?im)^.*\b(?:how to apply (?:these terms|the apache license)|how to use this license for your documents)\b.*$", text)[0]}
        forms |= {re.split(r"END OF TERMS AND CONDITIONS", x)[0] for x in forms}
        if i.startswith("BSD") or i == "Zlib":
            forms |= {re.sub(r"(?m)^\s*[0-9]\.\s", "", x) for x in forms}
        titles = [""] + ([NAMES[i], f"The {NAMES[i]} ({i})", f"{NAMES[i]} ({i})"] if i in NAMES else [])
        out += [(i, f"{t}\n{x}") for x in sorted(forms) for t in titles]
    return out


_ALL = [*NOTICES, *_families(), *_texts()]
KNOWN = [*_ALL, *((i, f"SPDX-License-Identifier: {j}") for i in sorted({i for i, _ in _ALL} - {RESERVED}) for j in ([i, f"{i}-only", f"{i}-or-later"] if "GPL" in i else [i]))]
# Spellings that count as equal, once only letters, digits and single spaces are left.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("per cent", "percent"), ("organisation", "organization"), ("merchantibility", "merchantability"), (r"\bhttps\b", "http"), (r"\bv ?(?=[0-9])", "version "), (r"\bneither the name of (?:\S+ ){1,16}?nor the names of", "neither the name of the copyright owner nor the names of")]
COPYRIGHT = r"(?m)^[^\p{L}\n]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|\[yyyy\]|<year>)|\(c\)|©|all rights reserved)[^\n]*$"
#: A line of a holder and the reservation: what stands before the reservation is left out.
HOLDER = r"^[^\p{L}]*(?:copyright\b|\(c\)|©).*?(?=\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)[^\p{L}\p{N}]*$)"
#: Lines without letters or digits part paragraphs.
GAP = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def _plain(lowered: Column) -> Column:
    out = F.regexp_replace(F.replace(lowered, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, *s), SPELLINGS, out))


def canonical(text: Column) -> Column:
    return _plain(F.regexp_replace(F.lower(text), COPYRIGHT, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def part_digest(text: Column) -> Column:
    """The digest of a line or paragraph: the reservation of rights is a notice there."""
    return F.sha2(_plain(F.regexp_replace(F.lower(text), HOLDER, "")), 256)


def registry(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, whole: bool = True) -> DataFrame:
    """digest, licence of the known texts, as whole texts or as lines and paragraphs: a fixed list,
    whatever the data. Texts that are equal in canonical form share a row of their sorted names."""
    rows = spark.createDataFrame(list(known), "licence string, t string")
    rows = rows.select("licence", (digest if whole else part_digest)(F.col("t")).alias("digest"), canonical(F.col("t")).alias("c"))
    rows = rows.where("c <> ''") if whole else rows
    return rows.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licence"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, text_digest, licence (of the whole text, or null), notices (sorted identifiers of the
    lines and paragraphs that are a known text, joined by commas, or an empty text) for every row of
    `docs`.

    A null text has a null digest and no licence; an empty one has the digest of nothing. Every line
    and every paragraph is looked up. Repeated rows are each returned; other columns are not read.
    The known digests are a fixed list and are broadcast.
    """
    spark = docs.sparkSession
    parts = registry(spark, known, whole=False).collect()
    digests = F.array(*(F.lit(r["digest"]) for r in parts)) if parts else F.array().cast("array<string>")
    names = F.create_map(*(F.lit(x) for r in parts for x in (r["digest"], r["licence"]))) if parts else F.create_map().cast("map<string,string>")
    text = F.coalesce("text", F.lit(""))
    paragraphs = F.filter(F.split(text, GAP), lambda x: x.contains("\n"))
    own = F.transform(F.concat(F.split(text, "\n"), paragraphs), part_digest)
    found = F.transform(F.array_intersect(own, digests), lambda x: F.try_element_at(names, x))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: F.split(x, ",")))))
    hashed = docs.select("doc_id", digest(F.col("text")).alias("text_digest"), F.array_join(found, ",").alias("notices"))
    whole = spark.createDataFrame(registry(spark, known).collect(), "digest string, licence string")
    return hashed.join(F.broadcast(whole), F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "licence", "notices")
