"""Licence scans by diagonal voting, with DataFrame operations only.

Every rolling ``GRAM``-word hash of a text is joined to the positions of the same hash in licence templates. A hit is
a vote for the diagonal (text position - template position). Votes are summed by diagonal; diagonals next to each other
are a band, and a band's hits that lie near each other are a span, so it survives inserted or missing words and stray
hits of other diagonals. A span is verified by the share of the template's positions that it covers, each counted once,
and by its length. Of templates that begin alike, as a licence's stricter variants do, the one that a place covers best stands,
and of those it covers as well the longest. Beside the templates' labels stand the base labels:
places where a phrase's words stand consecutively, found in the same pass.

Words are runs of characters other than ASCII ones that are no letters or digits, after A-Z became a-z.

Edge cases: a null text is empty; a text without words has no places, labels or positions and score 0; rows that are
equal in id and text are counted and each return a row; a null id is kept; an empty table gives an empty result; other
columns are ignored; a text of any length is exploded whole and only its hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: Share of a template's grams that a span must cover, and how much longer than the template it may be.
COVERED, STRETCH = 0.6, 1.6
#: How far apart merged diagonals, which are half a template apart at most, and hits of one span may be, in words.
DIAGONALS, GAP = 8, 12

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Well-known licence passages and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivs"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivs"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

#: Labels that begin so are of rival templates: they have their first words in common.
RIVALS = "cc-"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE, _END = -1, -2  # numbers below those of templates: a base place, and the end of a text


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _gram(all_words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(all_words, at + k) for k in range(GRAM)))


def template_grams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """Per gram hash, the templates and positions that have it: as many rows as the templates have words, at most."""
    rows = [(k, label, text) for k, (label, text) in enumerate(templates)]
    cut = spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", words(F.col("text")).alias("w"))
    placed = cut.select("template", "label", "w", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)).alias("at"), F.size("w").alias("length"))
    hit = F.struct("template", "at", "label", "length")
    return placed.select(_gram(F.col("w"), F.col("at")).alias("gram"), hit.alias("hit")).groupBy("gram").agg(F.collect_list("hit").alias("hits"))


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    key = ["doc_id", "text_key"]
    whole = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("w"))
    # one row more than there are words: it stands for the text itself
    each = whole.select(*key, "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "word"))
    at, w = F.col("at"), F.col("w")
    base = F.lit(None).cast("string")
    for phrase, label in phrases.items():
        first, *rest = phrase.split()
        here = F.col("word") == first
        for k, word in enumerate(rest, 1):
            here = here & F.coalesce(F.get(w, at + k) == word, F.lit(False))
        base = F.when(here, F.lit(label)).otherwise(base)
    marked = each.select(*key, "at", base.alias("base"), (at == F.size(w)).alias("end"), F.when(at <= F.size(w) - GRAM, _gram(w, at)).alias("gram"))
    joined = marked.join(F.broadcast(template_grams(documents.sparkSession, templates)), "gram", "left").filter(F.col("hits").isNotNull() | F.col("base").isNotNull() | F.col("end"))

    def event(template: Column, label: Column, place: Column, length: Column) -> Column:
        return F.struct(template.cast("int").alias("template"), label.alias("label"), place.cast("int").alias("place"), length.cast("int").alias("length"))

    votes = F.transform(F.coalesce("hits", F.array().cast("array<struct<template:int,at:int,label:string,length:int>>")), lambda h: event(h["template"], h["label"], h["at"], h["length"]))
    none = F.array().cast("array<struct<template:int,label:string,place:int,length:int>>")
    places = F.when(F.col("base").isNotNull(), F.array(event(F.lit(_BASE), F.col("base"), F.lit(0), F.lit(0)))).otherwise(none)
    ends = F.when(F.col("end"), F.array(event(F.lit(_END), F.lit(None).cast("string"), F.lit(0), F.lit(0)))).otherwise(none)
    events = joined.select(*key, "at", F.explode(F.concat(votes, places, ends)).alias("e")).select(*key, "at", "e.*")

    # all base places of a text are one diagonal, and so is its end
    diagonal = F.when(F.col("template") >= 0, at - F.col("place")).otherwise(0)
    by_diagonal = events.withColumn("diagonal", diagonal).groupBy(*key, "template", "label", "diagonal", "length").agg(F.count("*").alias("votes"), F.collect_set("place").alias("covers"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    template_key = [*key, "template", "label"]
    next_to = Window.partitionBy(*template_key).orderBy("diagonal")
    nearby = F.least(F.lit(DIAGONALS), F.floor(F.col("length") / 2))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(next_to) > nearby, F.lit(True))
    banded = by_diagonal.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(next_to))
    in_text = Window.partitionBy(*template_key, "band").orderBy("lo", "diagonal")
    far = F.coalesce(F.col("lo") - F.max("hi").over(in_text.rowsBetween(Window.unboundedPreceding, -1)) > GAP, F.lit(True))
    spans = banded.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(in_text))
    merged = spans.groupBy(*template_key, "length", "band", "span").agg(F.sum("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covers"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    covered = F.least(F.lit(1.0), F.col("covers") / F.greatest(F.col("length") - GRAM + 1, F.lit(1)))
    fits = (F.col("template") >= 0) & (covered >= COVERED) & (F.col("hi") - F.col("lo") + GRAM <= F.ceil(F.col("length") * STRETCH))
    family = F.when(F.col("label").startswith(RIVALS), RIVALS).otherwise(F.col("template").cast("string"))
    merged = merged.withColumn("covered", covered).withColumn("fits", fits).withColumn("family", family)
    rivals = Window.partitionBy(*key, "family", "lo").orderBy(F.desc("fits"), F.desc("covered"), F.desc("length"), "template")
    merged = merged.withColumn("place", F.row_number().over(rivals))
    verified, covered = F.col("fits") & (F.col("place") == 1), F.col("covered")
    is_base, is_end = F.col("template") == _BASE, F.col("template") == _END
    copies = F.sum(F.when(is_end, F.col("votes")))

    def listed(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    out = merged.groupBy(*key).agg(
        F.max(F.when(is_end, F.col("hi"))).cast("long").alias("n_words"),
        # rows equal in id and text vote as often as they occur
        (F.sum(F.when(is_base, F.col("votes")).otherwise(0)) / copies).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("hi"))).cast("long").alias("last_word"),
        listed(is_base).alias("base_labels"),
        listed(is_base | verified).alias("labels"),
        F.max(F.when(verified, covered).otherwise(0.0)).alias("score"),
        F.sum(verified.cast("long")).alias("n_spans"),
        copies.cast("int").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("text_key", "copies", "copy")
