"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Native: every step is a DataFrame or SQL function.

A text's words (letters and digits, lower case) give three-word shingles.  Only texts with an anchor
word are looked at: the anchors are chosen so that a template contained to ``MIN_CONTAINED`` must
contribute one, so nothing is lost.  Shingles that occur in no template cannot add to a containment
and are left out.  Templates are classed by length; a class's windows are twice its longest template
and overlap by half, so every occurrence lies whole in one window.  ``BANDS`` bands of one minimum
each retrieve a template whose shingles are a fifth of what a window holds with a chance of 99.9
percent, and one that fills it surely.  A candidate is a match if the window holds at least
``MIN_CONTAINED`` of the template's distinct shingles, counted exactly.

Null and empty texts have no matches; rows equal in id and text are one document; extra columns are
left out.  One row per document and license found.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, row_key

SHINGLE, BANDS, MIN_CONTAINED = 3, 32, 0.8
CLASSES = (16, 64, 256)         # longest template of a class, in words; doubled on until the longest template fits

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy "
        "of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to "
        "this work to the public domain worldwide. This work is distributed without any warranty."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "AGPL-notice": "under the terms of the GNU Affero General Public License",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
        "whom the Software is furnished to do so, all subject to the following:"
    ),
}
# Whole license texts, as files beside this module.
_FILES = {"BSD": "BSD-3-Clause"}
TEMPLATES |= {
    _FILES.get(p.stem, f"{p.stem}-text"): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
}


def classes(templates: dict[str, str]) -> list[int]:
    """The length classes: ``CLASSES``, and doubled from there until the longest template fits."""
    longest, limits = max((len(_words(t)) for t in templates.values()), default=0), list(CLASSES)
    while limits[-1] < longest:
        limits.append(2 * limits[-1])
    return limits


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def anchors(templates: dict[str, str], contained: float = MIN_CONTAINED) -> list[str]:
    """Words of which every template, contained to ``contained``, must show one.

    For each template, words are added until the shingles without any of them are fewer than a
    containment needs; words that few templates' shingles lack come first.
    """
    chosen: list[str] = []
    weight = Counter(w for t in templates.values() for w in set(_words(t)))
    for text in templates.values():
        words = _words(text)
        grams = {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
        while sum(not set(g) & set(chosen) for g in grams) >= contained * len(grams):
            bare = Counter(w for g in grams if not set(g) & set(chosen) for w in set(g) if len(w) > 4)
            bare = bare or Counter(w for g in grams if not set(g) & set(chosen) for w in set(g))
            chosen.append(min(bare, key=lambda w: (-len(w) * bare[w], -weight[w], w)))
    return sorted(set(chosen))


def text_words(text: str) -> Column:
    cleaned = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))
    return F.filter(F.split(cleaned, " "), lambda x: x != "")


def shingles(words: Column) -> Column:
    """Hashes of all shingles in word order; a shorter text is one shingle, an empty one none."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.coalesce(F.get(words, i + k), F.lit("")) for k in range(SHINGLE)]))
    return F.when(F.size(words) > 0, grams).otherwise(F.array().cast("array<bigint>"))


def _minima() -> list[Column]:
    return [F.min(F.xxhash64(F.lit(band), F.col("h"))).alias(f"m{band}") for band in range(BANDS)]


def _banded(df: DataFrame, *keys: str) -> DataFrame:
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("least")) for b in range(BANDS)])
    return df.select(*keys, F.explode(bands).alias("b")).select(*keys, "b.band", "b.least")


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, class, h): the distinct shingles of every template; its size is that of the list."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    held = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", text_words("t.text").alias("words"))
    limits = classes(templates)
    size, at = F.size("words"), F.lit(limits[-1])
    for limit in reversed(limits):
        at = F.when(size <= limit, F.lit(limit)).otherwise(at)
    return held.select("license", at.alias("class"), F.explode(F.array_distinct(shingles(F.col("words")))).alias("h"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, license, contained, first_word, n_windows) for every license found in a document."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = scratch.keep("templates", template_shingles(spark, templates))

    anchored = docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("_key"), F.col(text).alias("text")).where(
        F.col(text).rlike("(?i)" + "|".join(anchors(templates)))
    )
    split = anchored.select("id", "_key", text_words("text").alias("words"))       # a column, so that it is split once
    found = split.select("id", "_key", F.posexplode(shingles(F.col("words"))).alias("at", "h"))
    hits = scratch.keep("hits", found.join(known.select("h", "class").distinct(), "h").select("id", "_key", "class", "at", "h"))

    half = F.col("class")                                  # a window is two halves long and starts at each half
    place = F.floor(F.col("at") / half)
    windows = hits.select("id", "_key", "class", "at", "h", F.explode(F.array(place - 1, place)).alias("window"))
    window = ["_key", "class", "window"]                   # the key stands for the id, which may be null
    bands = _banded(windows.groupBy(*window).agg(*_minima()), *window)
    signatures = _banded(known.groupBy("license", "class").agg(*_minima()), "license", "class")
    candidates = bands.join(signatures, ["class", "band", "least"]).select(*window, "license").distinct()

    sizes = known.groupBy("license").agg(F.count_distinct("h").alias("of"))
    shared = (
        windows.join(candidates, window).join(known.select("license", "h"), ["license", "h"])
        .groupBy(*window, "license").agg(F.count_distinct("h").alias("n"), F.min("at").alias("first_word"), F.min("id").alias("id"))
        .join(sizes, "license").withColumn("contained", F.col("n") / F.col("of")).where(F.col("contained") >= MIN_CONTAINED)
    )
    return shared.groupBy("_key", "license").agg(
        F.min("id").alias("id"), F.max("contained").alias("contained"), F.min("first_word").alias("first_word"), F.count(F.lit(1)).alias("n_windows")
    ).select(F.col("id").alias(id_col), "license", "contained", F.col("first_word").cast("bigint").alias("first_word"), "n_windows")
