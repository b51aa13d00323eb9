"""License scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Units are a document's lines, if it has several the document as a whole, and
windows: any run of the document's words, across lines or inside one, of at most
the most bigrams that can reach the threshold.  A window counts where no line or
document matches the same template; of windows that overlap the best counts.  A
unit is put in lower case, everything but ASCII letters and digits becomes one
blank, and the set of its word bigrams is compared to each template's:
``dice = 2 * common / (unit + template)``.

Two exact prunings keep the scan linear.  Size bounds: a Dice coefficient of at
least ``threshold`` needs sizes within ``t / (2 - t)`` of each other, so most
units that are too short are dropped before any bigram is made, and a unit meets
only the templates of its size.  Anchors: with so many common bigrams a unit
cannot miss all of a template's ``anchors``, its first bigrams in an order that
puts those with common words last; a hashed look-up of anchors inside the scan
leaves few units, and only these are compared.

Windows are looked for in blocks of words around anchors, from each bigram of the
template that has enough others behind it to the best end.

Scale.  DataFrame functions only; a map-only scan, broadcasts of the anchors, whose
number is checked (``MAX_ANCHORS``), and of the templates, then one row per document
that has a match.  No group is gathered but a document's own matches.

Defined cases.  Null and empty texts, and units of one word, match nothing.
Repeated rows are separate documents if their ids differ; rows of one id are
scanned together.  Ties between templates go to the smaller template name.
Documents without a match have no licence, 0 matches and a best of 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_ANCHORS = 20_000

# Notices and texts of public licences, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "SPDX-line": "SPDX-License-Identifier: MIT",
    "Unlicense-head": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
#: Words so common that bigrams with them are anchors only if others don't suffice.
COMMON = ["a", "an", "and", "any", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you"]


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold with a template of that size."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9)), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors_of(own: list[str], threshold: float) -> list[str]:
    """Bigrams of which a unit that reaches the threshold has one at least."""
    # 2c >= t (a + b) and a >= c give c >= t b / (2 - t)
    least = max(1, math.ceil(len(own) * threshold / (2 - threshold) - 1e-9))
    ranked = sorted(own, key=lambda b: (sum(w in COMMON for w in b.split()), b))
    return ranked[: len(own) - least + 1]


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = [(name, bigrams(text)) for name, text in sorted(templates.items())]
    return spark.createDataFrame([(n, b, len(b)) for n, b in rows if b], "template string, own array<string>, size int")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Matches: ``doc_id, line, word, template, dice``; one row for each unit and template that reach the threshold.

    ``line`` is from 1, 0 for the whole document and -1 for a window; ``word`` is the unit's first word in the document, from 1.
    """
    spark = docs.sparkSession
    full = templates or TEMPLATES
    made = {name: bigrams(text) for name, text in full.items()}
    made = {name: own for name, own in made.items() if own}
    if not made:
        raise ValueError("no template has two words")
    anchors = [(b, name) for name, own in made.items() for b in anchors_of(own, threshold)]
    if len(anchors) > MAX_ANCHORS:
        raise ValueError(f"{len(anchors)} anchors are too many to broadcast")
    low, high = zip(*(size_bounds(len(own), threshold) for own in made.values()))
    low, high = min(low), max(high)
    reach = {name: size_bounds(len(re.sub("[^a-z0-9]+", " ", full[name].lower()).split()) - 1, threshold)[1] for name in made}
    names = sorted({b for b, _ in anchors})
    known = spark.createDataFrame(
        [({b: [(n, reach[n]) for a, n in anchors if a == b] for b in names},)], "known map<string, array<struct<template: string, reach: int>>>"
    )
    table = spark.createDataFrame([(n, own, len(own), *size_bounds(len(own), threshold), reach[n]) for n, own in made.items()], "template string, other array<string>, size int, low int, high int, reach int")

    text = F.col(text_col)
    # inline() also keeps the optimiser from copying what makes its columns into each later use
    held = lambda df, keep, **made: df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
    split = docs.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    split = held(split, ["doc_id", "row", "text"], w=F.split(normalise(F.col("text")), " "))
    split = held(split.filter(F.size("w") > low), ["doc_id", "row", "text"], pairs=_pairs(F.col("w")))
    # every unit's bigrams are bigrams of its document
    split = split.filter(F.exists("pairs", lambda b: b.isin(names)))
    lines = F.transform(F.split("text", "\n"), lambda x: F.filter(F.split(normalise(x), " "), lambda y: y != ""))
    split = held(split, ["doc_id", "row", "pairs"], lines=lines, at=F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: F.get("pairs", i - 1).isin(names)))
    firsts = F.aggregate("lines", F.array(F.lit(1)), lambda n, x: F.concat(n, F.array(F.element_at(n, -1) + F.size(x))))
    split = held(split, ["doc_id", "row", "pairs", "lines", "at"], firsts=firsts).crossJoin(F.broadcast(known))

    empty = F.lit(None).cast("string")
    # `skip`: a unit's last word, or the words before a window's blocks
    unit = lambda line, word, own, last: F.struct(line.alias("line"), word.alias("word"), empty.alias("template"), own.alias("own"), last.alias("skip"))
    units = F.transform("lines", lambda x, i: unit(i + 1, F.get("firsts", i), _pairs(x), F.get("firsts", i) + F.size(x) - 1))
    whole = F.filter(F.array(unit(F.lit(0), F.lit(1), F.col("pairs"), F.size("pairs") + 1)), lambda u: F.size("lines") > 1)
    # a window of at most `reach` bigrams with an anchor in block q lies in blocks q - 1 to q + 1
    blocks = F.array_distinct(F.flatten(F.transform("at", lambda i: F.transform(F.element_at("known", F.get("pairs", i - 1)), lambda t: F.struct(t["template"].alias("template"), t["reach"].alias("reach"), F.floor((i - 1) / t["reach"]).cast("int").alias("block"))))))
    windows = F.transform(
        blocks,
        lambda t: F.struct(
            F.lit(-1).alias("line"), F.lit(0).alias("word"), t["template"].alias("template"),
            F.slice("pairs", F.greatest((t["block"] - 1) * t["reach"], F.lit(0)) + 1, 3 * t["reach"]).alias("own"), F.greatest((t["block"] - 1) * t["reach"], F.lit(0)).alias("skip"),
        ),
    )
    rows = split.select("doc_id", "row", F.inline(F.concat(F.filter(units, lambda u: F.exists(u["own"], lambda b: b.isin(names))), whole, windows)))
    own = F.when(F.col("line") < 0, F.col("own")).otherwise(F.array_distinct("own"))
    rows = held(rows, ["doc_id", "row", "line", "word", "template", "skip"], own=own).filter((F.col("line") < 0) | F.size("own").between(low, high))
    hit = F.when(F.col("line") < 0, F.array("template")).otherwise(
        F.array_distinct(F.flatten(F.transform(F.filter("own", lambda b: b.isin(names)), lambda b: F.transform(F.element_at("known", b), lambda t: t["template"]))))
    )
    rows = rows.crossJoin(F.broadcast(known)).select("doc_id", "row", "line", "word", "skip", "own", F.explode(hit).alias("template")).join(F.broadcast(table), "template")
    rows = rows.filter((F.col("line") < 0) | F.size("own").between(F.col("low"), F.col("high")))

    # units as they are; of windows, every start at a bigram of the template with its best end
    keep = ["doc_id", "row", "line", "word", "skip", "template", "size"]
    ordered = F.when(F.col("line") < 0, F.array_sort(F.transform("own", lambda b, i: F.struct(b.alias("b"), i.alias("i")))))
    common = F.when(F.col("line") >= 0, F.size(F.array_intersect("own", "other")))
    rows = held(rows, [*keep, "low", "other", "reach"], n=F.size("own"), common=common, ordered=ordered)
    before = lambda x, k: F.when((k > 0) & (F.get("ordered", k - 1)["b"] == x["b"]), F.get("ordered", k - 1)["i"]).otherwise(-1)
    places = F.array_sort(F.transform("ordered", lambda x, k: F.struct(x["i"].alias("i"), before(x, k).alias("before"), F.array_contains("other", x["b"]).alias("hit"))))
    rows = held(rows, [*keep, "low", "reach", "n", "common"], places=places)
    rows = held(rows, [*keep, "low", "reach", "n", "common", "places"], hits=F.transform(F.filter("places", lambda x: x["hit"]), lambda x: x["i"]))
    starts = F.filter("hits", lambda s, k: (s < 2 * F.col("reach")) & (F.get("hits", k + F.col("low") - 1) - s < F.col("reach")))
    tried = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("places", s + 1, F.col("reach")).alias("seq")))
    rows = rows.select(*keep, "n", "common", F.explode(F.when(F.col("line") < 0, tried).otherwise(F.array(F.lit(None).cast("struct<s:int,seq:array<struct<i:int,before:int,hit:boolean>>>")))).alias("x"))
    fresh = lambda x: x["before"] < F.col("x.s")

    def step(n: Column, x: Column) -> Column:
        a, c = n["a"] + fresh(x).cast("int"), n["c"] + (fresh(x) & x["hit"]).cast("int")
        d = 2 * c / (a + F.col("size"))
        better = x["hit"] & (d > n["d"])
        return F.struct(a.alias("a"), c.alias("c"), F.when(better, d).otherwise(n["d"]).alias("d"), F.when(better, x["i"]).otherwise(n["e"]).alias("e"))

    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0.0).alias("d"), F.lit(0).alias("e"))
    rows = held(rows, [*keep, "n", "common", "x"], best=F.when(F.col("line") < 0, F.aggregate("x.seq", zero, step)))
    is_window = F.col("line") < 0
    rows = rows.select(
        "doc_id", "row", "line", "template", F.when(is_window, F.col("skip") + F.col("x.s") + 1).otherwise(F.col("word")).alias("word"),
        F.when(is_window, F.col("skip") + F.col("best.e") + 2).otherwise(F.col("skip")).alias("last"), F.when(is_window, F.col("best.d")).otherwise(2 * F.col("common") / (F.col("n") + F.col("size"))).alias("dice"),
    ).filter(F.col("dice") >= threshold - 1e-12).distinct()
    return _apart(rows)


def _apart(rows: DataFrame) -> DataFrame:
    """Units, and of the windows of a template those that meet no unit of it, the better one (then the shorter, then the first) where two overlap."""
    keys = ["doc_id", "row", "template"]
    by = Window.partitionBy(*keys).orderBy("word")
    is_unit = F.col("line") >= 0
    reached = F.max(F.when(is_unit, F.col("last"))).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(is_unit, F.col("word"))).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    free = F.coalesce(F.col("reached") < F.col("word"), F.lit(True)) & F.coalesce(F.col("ahead") > F.col("last"), F.lit(True))
    rows = rows.select("*", reached.alias("reached"), ahead.alias("ahead")).filter(is_unit | free)
    match = F.struct((-F.col("dice")).alias("worse"), (F.col("last") - F.col("word")).alias("longer"), "word", "last", "line", "dice")
    lists = rows.groupBy(*keys).agg(F.collect_list(F.when(is_unit, match)).alias("units"), F.array_sort(F.collect_list(F.when(~is_unit, match))).alias("windows"))
    meets = lambda x, y: (x["word"] <= y["last"]) & (y["word"] <= x["last"])
    chosen = F.aggregate("windows", F.slice("windows", 1, 0), lambda n, x: F.when(F.exists(n, lambda y: meets(x, y)), n).otherwise(F.concat(n, F.array(x))))
    out = lists.select("doc_id", "template", F.inline(F.concat("units", chosen)))
    return out.select("doc_id", "line", "word", "template", "dice").distinct()


def _pairs(w: Column) -> Column:
    # words that are not there give no bigram
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat_ws(" ", x, y))


def licences(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, n_matches, licences`` (sorted names), ``best, best_dice``."""
    found = scan(docs, templates, id_col=id_col, text_col=text_col, threshold=threshold)
    by = found.groupBy("doc_id").agg(
        F.count("*").alias("n_matches"), F.array_sort(F.collect_set("template")).alias("licences"), F.min(F.struct((-F.col("dice")).alias("d"), "template")).alias("first")
    )
    return docs.select(F.col(id_col).alias("doc_id")).join(by, "doc_id", "left").select(
        "doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("licences", F.expr("array()").cast("array<string>")).alias("licences"),
        F.col("first.template").alias("best"), F.coalesce(-F.col("first.d"), F.lit(0.0)).alias("best_dice"),
    )
