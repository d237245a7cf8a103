"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

A text's shingles of SHINGLE words are hashed once. For a template of n shingles
windows of n + stride - 1 shingles start at every stride-th one, so that one of
them holds any occurrence whole. The least hashes of a window under several hash
functions are its bands (of one row each); as many bands are taken as make a
window that reaches the containment collide with the template with probability
TARGET at least. Windows that collide are verified by the exact share of the
template's shingles that they hold. A window can collide only if it holds a
shingle on which the template's band stands, so others are passed over unhashed.

Edge cases: a null or empty text, or one of fewer than SHINGLE words, has no
license. Repeated rows give their rows each, also with null ids. A template of
fewer than SHINGLE words raises ValueError. Templates are part of the plan; beyond
AT_ONCE of them each further AT_ONCE take another pass. Only the columns named
are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, TARGET, AT_ONCE = 5, 0.8, 0.999, 1000
WORD_BREAK = r"[^\p{L}\p{N}]+"

#: Notices by which public licenses are declared.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
}

#: Whole licenses.
_LIABILITY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT"] + ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. " + _LIABILITY,
    "ISC-text": TEMPLATES["ISC"] + ". THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": TEMPLATES["BSD"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}

RECORD = "array<struct<id:string,n:int,need:int,width:int,stride:int,bands:array<bigint>,signature:array<bigint>,shingles:array<bigint>>>"


def shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words in lower case; an empty array where there are fewer."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    pair = F.struct(words.alias("w"))
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    # the words are bound once, as the one element of an array
    return F.flatten(F.transform(F.array(pair), lambda p: F.when(F.size(p["w"]) >= SHINGLE, runs(p["w"])).otherwise(F.array().cast("array<bigint>"))))


def band_settings(n: int) -> tuple[int, int, int, int]:
    """Shingles to hold, width and stride of the windows, and bands, for a template of n shingles.

    A window that holds ``need`` of them has a Jaccard similarity of at least
    need / (n + width - need); each band collides with that probability.
    """
    need = max(1, math.ceil(CONTAINMENT * n - 1e-9))
    stride = max(1, n // 4)
    width = n + stride - 1
    similarity = need / (n + width - need)
    bands = 1 if similarity >= 1 else math.ceil(math.log(1 - TARGET) / math.log(1 - similarity))
    return need, width, stride, bands


def least_hash(of: Column, band: Column | int) -> Column:
    return F.array_min(F.transform(of, lambda h: F.xxhash64(h, F.lit(band) if isinstance(band, int) else band)))


def _records(spark: SparkSession, templates: Mapping[str, str]) -> list[dict]:
    """The templates with their settings, bands and the shingles on which bands stand."""
    hashed = spark.createDataFrame(sorted(templates.items()), "id string, text string").select("id", F.array_distinct(shingles(F.col("text"))).alias("s")).collect()
    if short := [row.id for row in hashed if not row.s]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    most = max(band_settings(len(row.s))[3] for row in hashed)
    keyed = spark.createDataFrame([(row.id, row.s) for row in hashed], "id string, s array<bigint>")
    # for each band the least hash and the shingle that has it
    best = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda b: F.array_min(F.transform("s", lambda h: F.struct(F.xxhash64(h, b).alias("v"), h.alias("h")))))
    out = []
    for row in keyed.select("id", "s", best.alias("best")).collect():
        need, width, stride, bands = band_settings(len(row.s))
        own = row.best[:bands]
        out.append({"id": row.id, "n": len(row.s), "need": need, "width": width, "stride": stride, "bands": [b.v for b in own], "signature": sorted({b.h for b in own}), "shingles": row.s})
    return out


def find_licenses(df: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and license found in it: the id, license_id, the shingles held by the best window, their share, and its first word.

    One pass over the texts for AT_ONCE templates; nothing is shuffled.
    """
    if len(templates) > AT_ONCE:
        names = sorted(templates)
        parts = [find_licenses(df, {n: templates[n] for n in names[k : k + AT_ONCE]}, id_col, text_col) for k in range(0, len(names), AT_ONCE)]
        return reduce(DataFrame.unionByName, parts)
    records = _records(df.sparkSession, templates)
    known = F.from_json(F.lit(json.dumps(records)), RECORD)
    signatures = F.lit(sorted({h for r in records for h in r["signature"]}))
    s = F.col("_shingles")

    def window(t: Column, start: Column) -> Column:
        return F.slice(s, start + 1, t["width"])

    def collides(t: Column, w: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(t["bands"]) - 1), lambda b: least_hash(w, b) == F.get(t["bands"], b))

    def best(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(s) - 1, t["stride"])
        near = F.filter(starts, lambda a: F.arrays_overlap(window(t, a), t["signature"]))
        found = F.filter(near, lambda a: collides(t, window(t, a)))
        held = F.transform(found, lambda a: F.struct(F.size(F.array_intersect(t["shingles"], window(t, a))).alias("held"), (-a).alias("back")))
        return F.array_max(F.filter(held, lambda x: x["held"] >= t["need"]))

    hits = F.transform(F.filter(known, lambda t: F.arrays_overlap(s, t["signature"])), lambda t: F.struct(t["id"].alias("license_id"), t["n"].alias("n"), best(t).alias("best")))
    rows = df.select(F.col(id_col), shingles(F.col(text_col)).alias("_shingles")).filter(F.arrays_overlap("_shingles", signatures))
    found = rows.select(id_col, F.explode(F.filter(hits, lambda x: x["best"].isNotNull())).alias("hit"))
    return found.select(
        id_col,
        F.col("hit.license_id").alias("license_id"),
        F.col("hit.best.held").cast("long").alias("held"),
        (F.col("hit.best.held") / F.col("hit.n")).alias("containment"),
        (-F.col("hit.best.back")).cast("long").alias("first_word"),
    )
