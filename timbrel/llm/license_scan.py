"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

All is DataFrame expressions within a row; nothing is shuffled. A text's words (letters and digits, lower case) give
5-word shingles, hashed. Windows of shingles, one at every shingle, have two MinHash bands of one value each: the least and
the greatest hash. A template's windows have the same two bands, so an unchanged window always collides in both, and a
changed one does with the probability of its Jaccard similarity in each. A template of n shingles of which the threshold
lets m be missing keeps a run of (n - m) / (m + 1) or more of them; its windows are as long as that run, WINDOW at most. So
an edited copy that reaches the threshold holds a whole window, and is retrieved with certainty.

A retrieved template is verified at each of its windows: its distinct shingles that occur from its own length before the
window to its own length behind it, divided by its number of shingles, must reach the threshold.

Cases: null and empty text, and texts of fewer than five words, have no license; a null id is scanned like any other; each
repeated row is scanned; an empty table gives an empty result; other columns are ignored. Templates of fewer than five
words are refused. Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm.common import documents

WORDS = 5
WINDOW = 4
CONTAINMENT = 0.8

# Notices and headers of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(WORDS)]))
    return F.when(F.size(words) >= WORDS, hashed).otherwise(F.array().cast("array<bigint>"))


def width(n: int, containment: float = CONTAINMENT) -> int:
    """Shingles in a window of a template of ``n`` distinct ones."""
    missing = n - ceil(containment * n - 1e-9)
    return max(1, min(WINDOW, -(-(n - missing) // (missing + 1))))


def _band(shingles: Column, i: Column, size: int, pick) -> Column:
    return F.get(shingles, i) if size == 1 else pick(*[F.get(shingles, i + n) for n in range(size)])


def _templates(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int]]]:
    """The distinct shingles of each template, in order, hashed as the texts' are."""
    if any(len([w for w in re.split(r"[^\w]+|_", t) if w]) < WORDS for t in templates.values()):
        raise ValueError(f"a template has fewer than {WORDS} words")
    rows = spark.createDataFrame(list(templates.items()), "name string, text string").withColumn("words", words_of(F.col("text")))
    return [(r["name"], r["s"]) for r in rows.select("name", _shingles(F.col("words")).alias("s")).collect()]


def _longs(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(set(values))]).cast("array<bigint>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, licenses, containments, first_words) for each row of ``docs`` (doc_id, text): the templates found, in
    order of name, with the best containment of each and the word its first verified window begins at."""
    known = sorted(_templates(docs.sparkSession, TEMPLATES if templates is None else templates))
    sizes = {n: width(len(set(s)), containment) for n, s in known}
    bands = {n: [(pick, column, sorted({pick(s[i : i + sizes[n]]) for i in range(len(s) + 1 - sizes[n])})) for pick, column in ((min, F.least), (max, F.greatest))] for n, s in known}
    shared: dict[tuple, set[int]] = {}
    for n, of in bands.items():
        for pick, column, values in of:
            shared.setdefault((sizes[n], column), set()).update(values)

    # Each step is a column of its own, so that no expression is evaluated again for each element.
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    rows = rows.select("doc_id", _shingles(F.col("_words")).alias("_s"))
    s = F.col("_s")

    def hit(i: Column) -> Column:
        return reduce(or_, [_band(s, i, size, column).isin(sorted(values)) for (size, column), values in shared.items()])

    places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), hit)
    rows = rows.select("doc_id", "_s", F.when(F.size(s) > 0, places).otherwise(F.array().cast("array<int>")).alias("_hits"))
    hits = F.col("_hits")

    def found(name: str, own: list[int]) -> Column:
        size, mine = len(set(own)), _longs(own)
        def met(i: Column) -> Column:
            return reduce(or_, [_band(s, i, sizes[name], column).isin(values) for _, column, values in bands[name]])

        def contained(i: Column) -> Column:
            near = F.slice(s, F.greatest(F.lit(1), i + 1 - len(own)), 2 * len(own) + WINDOW)
            return F.size(F.array_intersect(near, mine)) / F.lit(size)

        scored = F.transform(F.filter(hits, met), lambda i: F.struct(contained(i).alias("c"), i.alias("at")))
        good = F.filter(scored, lambda x: x["c"] >= containment)
        best = F.struct(F.lit(name).alias("license"), F.array_max(F.transform(good, lambda x: x["c"])).alias("containment"), F.array_min(F.transform(good, lambda x: x["at"])).alias("at"))
        return F.when(F.size(good) > 0, best)

    each = F.filter(F.array(*[found(n, own) for n, own in known]), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<license:string,containment:double,at:int>>")
    rows = rows.select("doc_id", F.when(F.size(hits) > 0, each).otherwise(none).alias("_found"))
    return rows.select("doc_id", F.col("_found.license").alias("licenses"), F.col("_found.containment").alias("containments"), F.col("_found.at").alias("first_words"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
