"""Licence notices by Dice coefficient over word bigrams.

A text is cut into pieces at line breaks and behind ``.``, ``!``, ``?``, ``;`` or ``:`` and a
blank. Every piece, every run of pieces that holds no more words than the size bound allows for
the longest template (:func:`span`), so notices inside prose and over any number of lines as
well, and the text as a whole are normalised (lower case, runs of anything but letters and
digits become one blank) and compared with every template: ``2 |A n B| / (|A| + |B|)`` over
the sets of word bigrams. A set of size a can reach a score t only against sizes from
``a t / (2 - t)`` to ``a (2 - t) / t``; templates of other sizes are not compared. A match
also shares so many of a template's bigrams that one with a *cue* is among them
(:func:`cues`), so texts without any cue are passed over. Built-in expressions only.

A match stays unless one that overlaps it has a higher score, or an equal one and fewer
pieces, or as many and an earlier start; the whole text overlaps with all of its runs. Of
templates with equal scores the id that sorts first counts.

Null texts have no pieces; texts of one word have no bigrams and match nothing. doc_id may
be null or repeated: every row is scanned by itself. Other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered

# Notices by licence id, as their licences or common practice word them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
THRESHOLD = 0.8

# Words too common to be cues.
COMMON = frozenset("a above all an and any are as at be by can copies copy either except following for form forms free from general if in is it later library may name no not of on one or other provided public see subject terms that the this to under use used v version will with without work you".split())


def bigrams(text: str) -> list[str]:
    """The set of word bigrams of a normalised template, sorted."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def span(templates: tuple[tuple[str, str], ...], threshold: float) -> int:
    """Words of a run of several pieces, at most: those of the longest template, by the bound of sizes."""
    longest = max(len("".join(c if c.isascii() and c.isalnum() else " " for c in text).split()) for _, text in templates)
    return math.floor(longest * (2 - threshold) / threshold + 1e-9)


def cues(sets: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every text that matches a template holds one.

    A match shares ``t |A| / (2 - t)`` bigrams of a template at least, so cues are added
    until fewer are left without: the words of most bigrams first, long ones before short.
    """
    found: set[str] = set()
    for _, own in sets:
        need = math.ceil(threshold * len(own) / (2 - threshold) - 1e-9)
        while len(bare := [b for b in own if not found & set(b.split())]) >= need:
            words = sorted({w for b in bare for w in b.split()})
            found.add(min(words, key=lambda w: (w in COMMON, w.isdigit(), -sum(w in b.split() for b in bare), -len(w), w)))
    return sorted(found)


def _bigram_set(words: F.Column) -> F.Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (number of its first piece from 0; -1: the whole text), pieces (their number), license and score (Dice) of every match that reaches the threshold."""
    sets = [(name, bigrams(text)) for name, text in sorted(templates)]
    least, most = _fewest(sets, threshold), span(templates, threshold)
    # a search for a long cue is fast, and short ones would be found inside words; a generator holds the lower case for all of them
    found = cues(sets, threshold)
    short = "(?<![a-z0-9])(?:" + "|".join(x for x in found if len(x) < 5) + ")(?![a-z0-9])"
    has = reduce(operator.or_, (F.col("low").contains(x) for x in found if len(x) > 4), F.lit(False))
    if any(len(x) < 5 for x in found):
        has = has | F.col("low").rlike(short)
    rows = numbered(docs, "doc_id", "text").select(ROW, "doc_id", "text", F.explode(F.array(F.lower("text"))).alias("low")).where(has).drop("low")
    cut = F.split(F.regexp_replace("text", "([.!?;:])[ \\t]+", "$1\n"), "\n")
    words = F.transform(cut, lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    # A run whose first or last piece has no word of any template is outdone by the run without that piece, which
    # overlaps with all that it does, so it is not built. Generators hold what every run reads.
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for _, own in sets for b in own for w in b.split()})))
    # flat: all words; at: the number of each word's piece among those with words; first: the place of each piece's first word
    held = rows.select(ROW, "doc_id", F.explode(F.array(words)).alias("words"))
    held = held.select(ROW, "doc_id", F.explode(F.array(F.struct(F.size("words").alias("all"), F.expr("filter(transform(words, (x, i) -> named_struct('line', i, 'words', x)), p -> size(p.words) > 0)").alias("parts")))).alias("t"))
    flat, at = F.flatten("t.parts.words"), F.flatten(F.transform("t.parts", lambda p, j: F.array_repeat(j, F.size(p["words"]))))
    own = F.transform("t.parts", lambda p: F.arrays_overlap(p["words"], vocabulary))
    held = held.select(ROW, "doc_id", "t.all", F.explode(F.array(F.struct(F.col("t.parts.line").alias("line"), flat.alias("flat"), at.alias("at"), own.alias("own")))).alias("t")).select(ROW, "doc_id", "all", "t.*").where(F.size("flat") > 0)
    first = F.expr("filter(sequence(0, size(at) - 1), k -> k = 0 OR at[k] <> at[greatest(k - 1, 0)])")
    held = held.select("*", F.explode(F.array(first)).alias("first"))
    # the last piece that ends within the words of a run from piece j on, or j itself
    last = f"greatest(j, IF(first[j] + {most} >= size(flat), size(first) - 1, at[least(first[j] + {most}, size(flat) - 1)] - 1))"
    words_of = "slice(flat, first[j] + 1, IF(e + 1 < size(first), first[least(e + 1, size(first) - 1)], size(flat)) - first[j])"
    runs = F.expr(f"flatten(transform(filter(sequence(0, size(first) - 1), j -> own[j]), j -> transform(filter(sequence(j, {last}), e -> own[e]), e -> named_struct('line', line[j], 'pieces', line[e] - line[j] + 1, 'start', first[j], 'words', {words_of}))))")
    whole = F.expr(f"IF(size(flat) > {most} AND size(first) > 1, array(named_struct('line', -1, 'pieces', all, 'start', 0, 'words', flat)), CAST(array() AS array<struct<line:int,pieces:int,start:int,words:array<string>>>))")
    units = held.select(ROW, "doc_id", F.explode(F.concat(runs, whole)).alias("u")).select(ROW, "doc_id", "u.*").where(F.size("words") > least)
    grams = units.select(ROW, "doc_id", "line", "pieces", "start", _bigram_set(F.col("words")).alias("grams"))
    size = F.size("grams")
    scores = []
    for name, own in sets:
        literal = F.array(*(F.lit(b) for b in own))
        possible = size.between(len(own) * threshold / (2 - threshold), len(own) * (2 - threshold) / threshold)
        dice = F.lit(2.0) * F.size(F.array_intersect("grams", literal)) / (size + len(own))
        scores.append(F.when(possible, F.struct(dice.alias("score"), F.lit(name).alias("license"))))
    best = F.aggregate(F.array(*scores), F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("license")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    # a generator, as a filter on best would be pushed down and the sets be built again for every use
    scored = grams.select(ROW, "doc_id", "line", "pieces", "start", F.explode_outer(F.array(best)).alias("best"))
    matched = scored.where(F.col("best.score") >= threshold).select(ROW, "doc_id", "line", "pieces", "start", "best.license", "best.score")
    # runs that overlap start at most as many words apart as a run holds; the whole text overlaps with all
    by, run = Window.partitionBy(ROW), F.col("line") >= 0
    near = matched.withColumn("near", F.collect_list(F.when(run, F.struct("line", "pieces", "score"))).over(by.orderBy("start").rangeBetween(-most, most)))
    top = near.withColumn("run", F.max(F.when(run, F.col("score"))).over(by)).withColumn("whole", F.max(F.when(~run, F.col("score"))).over(by))
    better = F.exists("near", lambda x: (x["line"] < F.col("line") + F.col("pieces")) & (F.col("line") < x["line"] + x["pieces"]) & ((x["score"] > F.col("score")) | ((x["score"] == F.col("score")) & (F.struct(x["pieces"], x["line"]) < F.struct("pieces", "line")))))
    outdone = F.when(run, better | F.coalesce(F.col("whole") > F.col("score"), F.lit(False))).otherwise(F.coalesce(F.col("run") >= F.col("score"), F.lit(False)))
    kept = top.where(~outdone)
    return kept.select("doc_id", "line", "pieces", "license", "score")


def _fewest(sets: list[tuple[str, list[str]]], threshold: float) -> int:
    """Fewest bigrams of a unit that is compared at all."""
    return math.ceil(min(len(b) for _, b in sets) * threshold / (2 - threshold))


def per_document(found: DataFrame) -> DataFrame:
    """doc_id, n_lines and the license of the best match, of each document with one."""
    first = F.min(F.struct(-F.col("score"), F.col("line"), "license"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), first["license"].alias("license"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan() with scores in units of 1e-6; it passes over no text."""
    least, most = _fewest([(name, bigrams(text)) for name, text in templates], threshold), span(templates, threshold)
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(b) for b in bigrams(text))}])" for k, (name, text) in enumerate(sorted(templates)))
    return f"""
WITH templates(number, license, own) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS d, doc_id, string_split(regexp_replace(text, '([.!?;:])[ \t]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
w AS (SELECT d, doc_id, list_transform(parts, lambda x: list_filter(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '')) AS parts FROM d),
lines AS (SELECT d, doc_id, unnest(parts) AS own, unnest(range(len(parts))) AS line FROM w),
placed AS (SELECT *, len(own) AS n, sum(len(own)) OVER (PARTITION BY d ORDER BY line) AS upto, row_number() OVER (PARTITION BY d ORDER BY line) AS r FROM lines WHERE len(own) > 0),
ends AS (SELECT d, doc_id, line, r, upto - n AS before, unnest(range(0, {most})) AS ahead FROM placed),
runs AS (SELECT a.d, a.doc_id, a.line, b.line AS last FROM ends a JOIN placed b ON b.d = a.d AND b.r = a.r + a.ahead WHERE a.ahead = 0 OR b.upto - a.before <= {most}),
units AS (
  SELECT d, w.doc_id, line, last - line + 1 AS pieces, flatten(parts[line + 1 : last + 1]) AS words FROM runs JOIN w USING (d)
  UNION ALL SELECT d, doc_id, -1, len(parts), flatten(parts) FROM w WHERE len(flatten(parts)) > {most} AND len(list_filter(parts, lambda x: len(x) > 0)) > 1),
grams AS (SELECT row_number() OVER () AS u, d, doc_id, line, pieces, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM units WHERE len(words) > {least}),
own AS (SELECT number, unnest(own) AS pair FROM templates),
shared AS (SELECT u, number, count(*) AS common FROM (SELECT u, unnest(g) AS pair FROM grams) JOIN own USING (pair) GROUP BY u, number),
scored AS (SELECT d, doc_id, line, pieces, number, license, 2.0 * common / (len(g) + len(own)) AS score FROM shared JOIN grams USING (u) JOIN templates USING (number)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, line, pieces ORDER BY score DESC, number) AS k FROM scored WHERE score >= {threshold}) WHERE k = 1)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(pieces AS INTEGER) AS pieces, license, CAST(round(score * 1000000) AS BIGINT) AS score_ppm FROM best a
WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.d = a.d AND (
  a.line < 0 AND b.line >= 0 AND b.score >= a.score OR b.line < 0 AND a.line >= 0 AND b.score > a.score
  OR a.line >= 0 AND b.line >= 0 AND b.line < a.line + a.pieces AND a.line < b.line + b.pieces
  AND (b.score > a.score OR b.score = a.score AND (b.pieces < a.pieces OR b.pieces = a.pieces AND b.line < a.line))))"""
