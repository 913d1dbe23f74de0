"""License scans in DataFrame functions alone, row by row and without a shuffle.

A text that shares no shingle with any template contains none, so an index of the templates' shingles, some thousand
numbers, drops it first and loses nothing. All shingles of the other texts are covered by overlapping windows. MinHash
bands of the windows retrieve templates, and exact shingle containment in the whole text verifies them. A template of
n shingles is sought in windows of 4g shingles, one every g, with the least power of two g for which any run of n lies
whole inside a window; so a copy and its window have a Jaccard similarity J above 3/8, and one of which a quarter is
altered above 1/4. Each of BANDS bands is one row, so that a band collides with probability J: a whole copy is missed
with a probability below (5/8)^24 = 0.002 %, an altered one below 0.75^24 = 0.1 %. Templates of at most SHORT shingles
have windows of a single shingle and all their shingles as keys, which cannot miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, CONTAINED = 5, 0.75
# License lines and notices in the wording that their licenses give.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Whole license texts, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
TEMPLATES |= {"mit-text": MIT, "isc-text": ISC, "bsd-2-clause-text": f"{BSD_HEAD} {BSD_TAIL}", "bsd-3-clause-text": f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}", "unlicense-text": UNLICENSE}
BANDS, SHORT, LEAST = 24, 12, 4  # rows of the signature; shingles of a short template; the least g


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """Hashes of the runs of five words in order; fewer words give none."""
    n = F.size(ws) - WORDS + 1
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(*[F.get(ws, i - 1 + k) for k in range(WORDS)])))


def least_hashes(hashes: Column, size: int) -> Column:
    """For each band the least permuted hash of each run of ``size`` shingles, one run behind the other."""
    starts = lambda: F.sequence(F.lit(1), F.size(hashes), F.lit(size))
    least = lambda i, band: F.array_min(F.transform(F.slice(hashes, i, size), lambda h: F.xxhash64(h, band)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.transform(starts(), lambda i: least(i, band))))


def coarser(least: Column, factor: int) -> Column:
    """The same for runs ``factor`` times as long."""
    return F.transform(least, lambda runs: F.transform(F.sequence(F.lit(1), F.size(runs), F.lit(factor)), lambda i: F.array_min(F.slice(runs, i, factor))))


def windows(least: Column) -> Column:
    """For each band the least hash of each window of four runs, one window for each run."""
    return F.transform(least, lambda runs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(runs) - 3, F.lit(1))), lambda i: F.array_min(F.slice(runs, i, 4))))


def spacing(shingles: list[int]) -> int:
    """g for a template; 0 for a short one."""
    g = LEAST
    while 3 * g + 1 < len(shingles):
        g *= 2
    return g if len(shingles) > SHORT else 0


def _templates(docs: DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """Name, shingles and signature of each template, from the same expressions as a text's."""
    spark = docs.sparkSession
    given = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in sorted(TEMPLATES.items())])
    rows = spark.range(1).select(F.inline(given)).select("name", shingles(words(F.col("text"))).alias("s"))
    rows = rows.select("name", F.array_distinct("s").alias("s"), F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.array_min(F.transform("s", lambda h: F.xxhash64(h, band)))).alias("least"))
    return [(r["name"], r["s"], r["least"]) for r in rows.collect()]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses and licenses (sorted names joined by commas), one row for each input row.

    A template is found where CONTAINED of its distinct shingles stand in the text. Null, empty and short texts have
    none; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in sorted(xs)]).cast("array<bigint>")
    known = _templates(docs)
    scales = sorted({g for _, s, _ in known if (g := spacing(s))})
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingles(F.col("w")).alias("s"))
    rows = rows.withColumn("k", F.array_intersect("s", longs({x for _, s, _ in known for x in s})))
    rows = rows.withColumn("k0", F.array_intersect("k", longs({x for _, s, _ in known if not spacing(s) for x in s})))
    rows = rows.withColumn("m", least_hashes(F.when(F.size("k") > 0, F.col("s")).otherwise(F.array().cast("array<bigint>")), LEAST))
    for g in scales:
        signature = windows(coarser(F.col("m"), g // LEAST) if g > LEAST else F.col("m"))
        rows = rows.withColumn(f"k{g}", F.array_intersect(F.flatten(signature), longs({x for _, s, least in known if spacing(s) == g for x in least})))
    found = []
    for name, s, least in known:
        g = spacing(s)
        retrieved = F.arrays_overlap(f"k{g}", longs(least if g else s))
        contained = F.size(F.array_intersect("k", longs(s))) >= CONTAINED * len(s)
        found.append(F.when((F.size(f"k{g}") > 0) & retrieved & contained, F.lit(name)))
    names = F.array_compact(F.array(*found))
    return rows.withColumn("names", names).select("doc_id", F.size("names").cast("long").alias("n_licenses"), F.concat_ws(",", "names").alias("licenses"))


def sql() -> str:
    """The same rows by plain containment over strings."""
    split = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    grams = lambda w: f"list_transform(range(1, len({w}) - {WORDS - 2}), lambda i: array_to_string({w}[i:i+{WORDS - 1}], ' '))"
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH t AS (SELECT name, list_distinct({grams('w')}) AS g FROM (SELECT name, {split('text')} AS w FROM (VALUES {values}) v(name, text))),
d AS (SELECT doc_id, {grams('w')} AS g FROM (SELECT doc_id, {split("coalesce(text, '')")} AS w FROM documents)),
m AS (SELECT doc_id, name FROM d, t WHERE len(list_intersect(d.g, t.g)) >= {CONTAINED} * len(t.g))
SELECT d.doc_id, count(m.name) AS n_licenses, coalesce(string_agg(m.name, ',' ORDER BY m.name), '') AS licenses
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""
