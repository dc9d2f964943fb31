"""License scan by MinHash bands over overlapping text windows, with Spark expressions only.

Words are runs of letters and digits in lower case. Shingles are five words long; a template of fewer
words is one shingle of its own width. Templates of s shingles belong to the window size W that is the
least power of two of at least 2 s; windows of W shingles start every W / 2, so a copy of a template
lies whole in one of them. A window that holds a share of 0.8 of a template has a Jaccard similarity
of at least 0.8 (W/4) / (W + 0.2 W/4) = 0.19 with it, so with 64 bands of one row each a window misses
the template with a probability below (1 - 0.19)^64 = 1.4e-6. Retrieved pairs are verified by the
exact share of the template's shingles in the window.

A window can only agree with a template in a band if it holds the very shingle that gives the template
its minimum there. Windows without any such shingle are left out before hashing; that loses nothing.

Defined cases: null, empty and short texts match nothing; repeated rows of one id merge into one
result row for each template; a null id is a group of its own; other columns are ignored; a document
of any length is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, SHARE, BANDS = 5, 0.8, 64

# The wording of common licenses and notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-line": "Licensed under the GNU Lesser General Public License, version 3.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """Hashes of all runs of so many words, in order."""
    n = F.size(w) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.when(n >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def _minimum(window: Column, band: int) -> Column:
    return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band))))


def _minima(window: Column) -> Column:
    return F.array(*[_minimum(window, b) for b in range(BANDS)])


def _first(window: Column, band: int) -> Column:
    """The shingle that gives the minimum."""
    return F.array_min(F.transform(window, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("v"), x.alias("x"))))["x"]


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns only, each worked out once: generated columns are not merged into later expressions."""
    return df.select(F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _templates(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[tuple[int, int, list[int]]]]:
    """(license, width, size, wanted, band, value), and for each width and window size the shingles that give minima.
    Templates are hashed by the same expressions as documents; there is one row for each here, on the driver."""
    named = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    sized = [(r["license"], min(len(r["w"]), SHINGLE), r["w"]) for r in named.collect() if r["w"]]
    hashed = []
    for width in sorted({k for _, k, _ in sized}):
        part = spark.createDataFrame([(n, w) for n, k, w in sized if k == width], "license string, w array<string>")
        hashed += [(r["license"], width, 2 << (len(r["h"]) - 1).bit_length(), r["h"]) for r in part.select("license", F.array_distinct(shingles(F.col("w"), width)).alias("h")).collect()]
    base = spark.createDataFrame(hashed, "license string, width int, size int, wanted array<bigint>")
    rows = base.select("*", _minima(F.col("wanted")).alias("minima"), F.array(*[_first(F.col("wanted"), b) for b in range(BANDS)]).alias("first")).collect()
    groups: dict[tuple[int, int], set[int]] = {}
    for r in rows:
        groups.setdefault((r["width"], r["size"]), set()).update(r["first"])
    flat = [(r["license"], r["width"], r["size"], r["wanted"], b, v) for r in rows for b, v in enumerate(r["minima"])]
    return spark.createDataFrame(flat, "license string, width int, size int, wanted array<bigint>, band int, value bigint"), [(k, w, sorted(v)) for (k, w), v in sorted(groups.items())]


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, share (best of any window), first_word (of the first best window), n_windows."""
    bands, groups = _templates(spark, templates)
    longs = lambda values: F.lit([int(v) for v in values]).cast("array<bigint>")
    widths = sorted({k for k, _, _ in groups})
    rows = _bound(docs, doc_id=F.col(id_col), w=words(F.col(text_col)))
    rows = _bound(rows, doc_id=F.col("doc_id"), **{f"h{k}": shingles(F.col("w"), k) for k in widths})
    kept = {"doc_id": F.col("doc_id")} | {f"h{k}": F.col(f"h{k}") for k in widths}
    rows = _bound(rows, **kept, **{f"p{k}_{size}": F.array_intersect(f"h{k}", longs(first)) for k, size, first in groups})

    def windows(k: int, size: int) -> Column:
        """Windows that hold one of the wanted shingles: each position lies in two."""
        h, present, half = F.col(f"h{k}"), F.col(f"p{k}_{size}"), size // 2
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))), lambda i: F.array_contains(present, F.get(h, i)))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / half).cast("int"), F.greatest(F.floor(i / half).cast("int") - 1, F.lit(0))))))
        made = F.transform(starts, lambda m: F.struct(F.lit(k).alias("width"), F.lit(size).alias("size"), (m * half).alias("start"), F.slice(h, m * half + 1, F.lit(size)).alias("window")))
        return F.when(F.size(present) > 0, made).otherwise(F.array().cast("array<struct<width:int,size:int,start:int,window:array<bigint>>>"))

    cut = rows.select("doc_id", F.inline(F.concat(*[windows(k, size) for k, size, _ in groups])))
    cut = _bound(cut, doc_id=F.col("doc_id"), width=F.col("width"), size=F.col("size"), start=F.col("start"), window=F.array_distinct("window"))
    banded = cut.select("*", F.posexplode(_minima(F.col("window"))).alias("band", "value"))
    # the templates are fixed by the caller: 64 rows for each, whatever the documents
    near = banded.join(F.broadcast(bands), ["width", "size", "band", "value"]).select("doc_id", "license", "start", "window", "wanted")
    held = near.withColumn("share", F.size(F.array_intersect("window", "wanted")) / F.size("wanted")).filter(F.col("share") >= share)
    best = held.groupBy("doc_id", "license").agg(F.max(F.struct("share", (-F.col("start")).alias("minus"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.share").alias("share"), (-F.col("best.minus")).alias("first_word"))
