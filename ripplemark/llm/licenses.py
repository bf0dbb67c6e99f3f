"""License scans with MinHash bands over overlapping text windows, in DataFrame operations only.

Templates and texts are turned into shingles of five words.  A window is a run of shingles, of a length that suits the
template (1, 4 or 16); texts have a window every half length, templates one at every shingle, so a window of a text that
lies in a copy of a template is one of the template's.  Each window has ``BANDS`` bands of one MinHash value: windows
of similarity 0.8 share a band with a probability of 1 - 0.2 ** 4 = 0.998, equal ones always.

A template retrieved by a band is verified once for a text, by exact containment: the share of its distinct shingles that
the text has.  Up to ``keys_in_place`` band values are looked up inside the row, and only texts with a hit keep their
shingles, once; more are met in a broadcast join, templates in blocks of bounded size.  Either way hits are positions
only, so a long template in a long text costs their lengths and not the product of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm.common import checkpointed, let

WORDS = 5
BANDS = 4
#: Window length in shingles, and the least number of shingles of a template that it serves.
SIZES = {1: 1, 4: 5, 16: 23}

HIT = "array<struct<size:int,band:int,at:int,key:bigint>>"
#: Shingles of templates that are broadcast at once, as 8 bytes each.
BLOCK_SHINGLES = 4_000_000
#: Band values of templates that are broadcast at once.
BLOCK_KEYS = 1_000_000

#: Fixed texts: notices by which common licenses are granted or named.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-text": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain.",
}


def _range(start: Column | int, end: Column, step: int = 1) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.when(end >= start, F.sequence(start, F.greatest(start, end), F.lit(step))).otherwise(F.array().cast("array<int>"))


def shingles(text: Column, words: int = WORDS) -> Column:
    """The hashes of all runs of ``words`` words (letters and digits of ASCII, in lower case), in order."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    return let(split, lambda w: F.transform(_range(1, F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words))))


def _bands(own: Column, size: int, step: int, keep=None) -> Column:
    """``at`` (1-based) and ``key`` of every window's bands, or of those that ``keep(band, key)`` holds for."""
    parts = []
    for band in range(1 if size == 1 else BANDS):
        seeded = own if size == 1 else _seeded(own, band)

        parts.append(let(seeded, _windows(size, step, band, keep)))
    return F.concat(*parts)


def _windows(size: int, step: int, band: int, keep):
    def key(h: Column, i: Column) -> Column:
        return F.get(h, i - 1) if size == 1 else F.array_min(F.slice(h, i, size))

    def windows(h: Column) -> Column:
        at = _range(1, F.size(h) - (size - 1), step)
        if keep is not None:
            at = F.filter(at, lambda i: keep(band, key(h, i)))
        return F.transform(at, lambda i: F.struct(F.lit(size).alias("size"), F.lit(band).alias("band"), i.alias("at"), key(h, i).alias("key")))

    return windows


def _seeded(own: Column, band: int) -> Column:
    return F.transform(own, lambda x: F.xxhash64(x, F.lit(band)))


def _hits(sets: dict[tuple[int, int], list[int]]):
    """Of a text's shingles, the windows with a band value in ``sets``."""

    def hits(h: Column) -> Column:
        found = [F.array().cast(HIT)]
        for length in sorted({size for size, _ in sets}):
            found.append(_bands(h, length, max(1, length // 2), lambda band, key, n=length: key.isin(sets.get((n, band), []))))
        return F.concat(*found)

    return hits


def _every_window(h: Column) -> Column:
    return F.concat(*[_bands(h, length, max(1, length // 2)) for length in SIZES])


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("template_id"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()])
    return spark.range(1).select(F.inline(rows))


def templates_from(spark: SparkSession, folder: str) -> DataFrame:
    """One template for each text file of ``folder`` (a list of whole licenses, say), named by its file without the suffix."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("f"), F.col("value").alias("text"))
    return files.select(F.regexp_replace("f", r"(?<=.)\.[^.]*$", "").alias("template_id"), "text")


def scan(docs: DataFrame, templates: DataFrame, columns: list[str], text: str = "text", containment: float = 0.8, keys_in_place: int = 4000, block_keys: int = BLOCK_KEYS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``columns`` with ``licenses``: ``template_id``, ``containment`` and ``at`` (first shingle of the first window met), by id.

    A template counts if it shares a band with a window of the text and the text has at least ``containment`` of its
    distinct shingles.  Null and empty texts and texts of under five words have none; so have templates of under five
    words or with a null id.  Templates with one id are one template with several texts, of which the best counts.
    Repeated rows each get theirs; an empty table gives an empty result.  ``columns`` may have any names.  The texts are
    read once, whatever the number of templates.
    """
    own = templates.where(F.col("template_id").isNotNull()).select(F.col("template_id").cast("string").alias("template_id"), shingles(F.col("text")).alias("own"))
    own = checkpointed(own.where(F.size("own") > 0).distinct()).withColumn("t", F.monotonically_increasing_id()).withColumn("n", F.size("own"))
    size = F.lit(None).cast("int")
    for length, least in SIZES.items():
        size = F.when(F.col("n") >= least, length).otherwise(size)
    bands = None
    for length in SIZES:
        part = own.where(size == length).select("t", F.explode(_bands(F.col("own"), length, 1)).alias("b")).select("t", "b.size", "b.band", "b.key").distinct()
        bands = part if bands is None else bands.unionByName(part)
    bands = checkpointed(bands)
    keys = bands.select("size", "band", "key").distinct()
    n_keys, n_shingles = bands.count(), own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = [f"_c{i}" for i in range(len(columns))]
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], shingles(F.col(f"`{text}`")).alias("_s"))
    in_place = n_keys <= keys_in_place
    if in_place:
        sets: dict[tuple[int, int], list[int]] = {}
        for r in keys.collect():
            sets.setdefault((r["size"], r["band"]), []).append(r["key"])
        base = base.select(*names, let(F.col("_s"), lambda h: let(_hits(sets)(h), lambda x: F.struct(x.alias("h"), F.when(F.size(x) > 0, h).alias("s")))).alias("_f"))
        base = base.select(*names, F.col("_f.h").alias("_h"), F.col("_f.s").alias("_s"))
    found = checkpointed(base).withColumn("_id", F.monotonically_increasing_id())
    hits = found.select("_id", F.explode("_h" if in_place else _every_window(F.col("_s"))).alias("h")).select("_id", "h.*")
    blocks = max(1, math.ceil(n_keys / block_keys), math.ceil(n_shingles / block_shingles))
    rows = None
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("t"), F.lit(blocks)) == k
        met = hits.join(F.broadcast(bands.where(mine)), ["size", "band", "key"]).groupBy("_id", "t").agg(F.min("at").alias("at"))
        met = met.groupBy("_id").agg(F.collect_list(F.struct("t", "at")).alias("m"))  # at most the templates of a block
        each = found.select("_id", "_s").where(F.col("_s").isNotNull()).join(met, "_id").select("_id", "_s", F.inline("m"))
        each = each.join(F.broadcast(own.where(mine).select("t", "template_id", F.array_distinct("own").alias("own"))), "t")
        each = each.select("_id", "template_id", "at", (F.size(F.array_intersect("_s", "own")) / F.size("own")).alias("containment")).where(F.col("containment") >= containment)
        rows = each if rows is None else rows.unionByName(each)
    best = rows.groupBy("_id", "template_id").agg(F.max("containment").alias("containment"), F.min("at").alias("at"))
    best = best.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("template_id", "containment", "at"))).alias("_l"))
    none = F.array().cast("array<struct<template_id:string,containment:double,at:int>>")
    out = found.select("_id", *names).join(best, "_id", "left")
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names)], F.coalesce("_l", none).alias("licenses"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents against the built-in templates: ids of the licenses found, joined by a comma, and how many."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_templates(spark), ["doc_id"])
    ids = F.array_join(F.transform("licenses", lambda x: x["template_id"]), ",")
    least = F.coalesce(F.round(F.array_min(F.transform("licenses", lambda x: x["containment"])), 6), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), ids.alias("licenses"), least.alias("min_containment"))
