"""Licence scans: TF-IDF cosine to templates, then inheritance by directory.

Statements of a document are the whole text, its paragraphs of several lines and its
lines that hold a licence cue, and all of these lines together. Each is a sparse TF-IDF
vector; its cosine to each template, a header or a licence's own wording, decides the
document's licence. A document whose whole text is like a template is a licence file: a
document without a licence of its own takes the one of the nearest ancestor directory
that has a licence file. Directories, not documents, are joined with their ancestors'
licences.

Built-in functions only. Documents are read once: what is kept of each are the template
words it has and, where it holds a cue, its statements. The inverse document frequencies
count all documents; only the templates' own words are counted, so the counts are as few
as those words, and so is the table of template vectors that statements are joined with.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.llm.common import checkpointed

#: Licence and wording: headers as licences are usually cited, notices that they ask to be
#: put in files, and the text of the short ones.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages, however caused and on any theory of liability."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages, however caused and on any theory of liability."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "Copyright. All rights reserved."),
]
#: A text or line without any of these is no statement.
CUE = r"licen[cs]e|copyright|copyleft|all rights reserved|redistribut|free of charge|without warrant|creative commons|public domain|spdx"
THRESHOLD = 0.6
NOT_WORD = "[^a-z0-9]+"
#: What parts paragraphs.
BLANK = r"\n[ \t]*\n"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def vocabulary(templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in words_of(t)})


def _words(low: Column) -> Column:
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def statements(low: Column) -> Column:
    """The whole text, its paragraphs of several lines and lines with a cue, and all of
    these lines together; nothing twice."""
    told = F.filter(F.split(low, "\n"), lambda line: line.rlike(CUE))
    blocks = F.filter(F.split(low, BLANK), lambda block: block.contains("\n") & block.rlike(CUE))
    return F.array_distinct(F.concat(F.array(low), blocks, told, F.array(F.array_join(told, " "))))


def template_vectors(docs: DataFrame, met: str, templates: list[tuple[str, str]]) -> tuple[DataFrame, float]:
    """A row for each template word: w, idf = ln((n + 1) / (df + 1)) + 1 over all documents
    and unit, its part in each template's unit vector; and the idf of a word in no
    document. As many rows come to the driver and go back as there are template words."""
    counts = {r["w"]: r["count"] for r in docs.select(F.explode(met).alias("w")).groupBy("w").count().collect()}
    n = counts.get("", 0)
    of = lambda df: math.log((n + 1) / (df + 1)) + 1
    idf = {w: of(counts.get(w, 0)) for w in vocabulary(templates)}
    units = []
    for _, text in templates:
        vector = {w: c * idf[w] for w, c in Counter(words_of(text)).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        units.append({w: v / norm for w, v in vector.items()})
    rows = json.dumps([{"w": w, "idf": v, "unit": [u.get(w, 0.0) for u in units]} for w, v in idf.items()])
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<w:string,idf:double,unit:array<double>>>")))
    return table, of(0)


def own_licences(stated: DataFrame, vectors: DataFrame, unseen: float, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """Documents (doc_id, key, said) with a statement: doc_id, key, is_file, licence (null
    under the threshold) and score: of the whole text if that is like a template, else of
    the best statement."""
    names = ["doc_id", "key", "statement"]
    told = stated.select("doc_id", "key", F.posexplode("said").alias("statement", "line"))
    # repeated rows count each word again: the vector's direction stays
    counted = told.select(*names, F.explode(_words(F.col("line"))).alias("w")).groupBy(*names, "w").count()
    # as many rows as template words, whatever the corpus
    weighed = counted.join(F.broadcast(vectors), "w", "left").withColumn("x", F.col("count") * F.coalesce("idf", F.lit(unseen)))
    dots = [F.sum(F.col("x") * F.coalesce(F.get("unit", F.lit(i)), F.lit(0.0))).alias(f"dot{i}") for i in range(len(templates))]
    scored = weighed.groupBy(*names).agg(F.sum(F.col("x") * F.col("x")).alias("square"), *dots)
    cosines = F.array(*[F.struct(F.round(F.col(f"dot{i}") / F.sqrt("square"), 6).alias("score"), F.lit(-i).alias("at")) for i in range(len(templates))])
    best = scored.withColumn("best", F.array_max(cosines)).groupBy("doc_id", "key").agg(F.max("best").alias("any"), F.max(F.when(F.col("statement") == 0, F.col("best"))).alias("whole"))
    is_file = F.coalesce(F.col("whole.score") >= threshold, F.lit(False))
    chosen = best.select("doc_id", "key", is_file.alias("is_file"), F.when(is_file, F.col("whole")).otherwise(F.col("any")).alias("best"))
    licence = F.array(*[F.lit(n) for n, _ in templates])
    return chosen.select("doc_id", "key", "is_file", F.when(F.col("best.score") >= threshold, F.element_at(licence, 1 - F.col("best.at"))).alias("licence"), F.col("best.score").alias("score"))


def scan(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = "path", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """The licence of every document of df, whose path has directories split by ``/``.

    Null and empty texts have no statement; a very long text is one statement like any
    other; a null path is the root's; ties go to the template that comes first, and
    between a directory's files to the higher score, then to the name; repeated rows are
    judged alike; an empty table gives no rows; other columns are left out. Returns
    doc_id, path, own_licence, own_score, licence, origin (own, inherited or none) and
    inherited_from (a directory; "" is the root)."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    mine = F.array(*[F.lit(w) for w in vocabulary(templates)])
    met = F.array_append(F.array_intersect(_words(F.col("low")), mine), F.lit(""))
    said = F.when(F.col("low").rlike(CUE), statements(F.col("low")))
    docs = checkpointed(docs.select("doc_id", "key", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), met.alias("met"), said.alias("said")))
    vectors, unseen = template_vectors(docs, "met", templates)
    own = checkpointed(own_licences(docs.where("said is not null"), vectors, unseen, templates, threshold))
    narrow = docs.select("doc_id", "key", "path", "dir")
    known = own.select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), "is_file", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("key") == F.col("o_key"))
    judged = narrow.join(known, same, "left")
    best = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l"))).alias("best")
    files = narrow.join(known.where("is_file and own_licence is not null"), same).groupBy(F.col("dir").alias("at")).agg(best).select("at", F.col("best.l").alias("dir_licence"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ancestors = (
        narrow.select("dir").distinct().withColumn("parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts"))))
        .select("dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice("parts", 1, F.col("depth")), "/")).alias("ancestor"))
    )
    nearest = (
        ancestors.join(files, F.col("ancestor") == F.col("at")).groupBy(F.col("dir").alias("of"))
        .agg(F.max(F.struct("depth", "ancestor", "dir_licence")).alias("near")).select("of", F.col("near.ancestor").alias("near"), F.col("near.dir_licence").alias("dir_licence"))
    )
    has = F.col("own_licence").isNotNull()
    return judged.join(nearest, F.col("dir") == F.col("of"), "left").select(
        "doc_id", "path", "own_licence", F.coalesce("own_score", F.lit(0.0)).alias("own_score"), F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(has, F.lit("own")).when(F.col("dir_licence").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(~has, F.col("near")).alias("inherited_from"),
    )


def document_path(doc_id: str = "doc_id", source: str = "source") -> Column:
    """A repository path for documents that have none: source, then folders of 5000 and
    of 100 consecutive ids."""
    folder = lambda n: F.coalesce(F.expr(f"{doc_id} div {n}").cast("string"), F.lit("none"))
    return F.concat_ws("/", F.coalesce(F.col(source), F.lit("unknown")), folder(5000), folder(100), F.concat(folder(1), F.lit(".txt")))


def oracle() -> str:
    """The scan of documents in DuckDB's SQL."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))
    split = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '{NOT_WORD}'), lambda w: w <> '')"
    return f"""
WITH docs AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, 'unknown'), coalesce(CAST(doc_id // 5000 AS VARCHAR), 'none'), coalesce(CAST(doc_id // 100 AS VARCHAR), 'none')) AS dir,
         coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' AS name FROM documents),
templates(i, licence, body) AS (VALUES {templates}),
template_words AS (SELECT i, w, count(*) AS tf FROM (SELECT i, unnest({split('body')}) AS w FROM templates) GROUP BY i, w),
n AS (SELECT count(*) AS n FROM docs),
met AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct({split("coalesce(text, '')")})) AS w FROM docs) WHERE w IN (SELECT w FROM template_words) GROUP BY w),
idf AS (SELECT t.w, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT w FROM template_words) t LEFT JOIN met ON met.w = t.w, n),
unit AS (SELECT i, t.w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY i)) AS x FROM template_words t JOIN idf ON idf.w = t.w),
told AS (
  SELECT doc_id, low, list_filter(string_split(low, chr(10)), lambda l: regexp_matches(l, '{CUE}')) AS told, list_filter(regexp_split_to_array(low, '{BLANK}'), lambda l: contains(l, chr(10)) AND regexp_matches(l, '{CUE}')) AS blocks
  FROM (SELECT doc_id, lower(text) AS low FROM docs) WHERE regexp_matches(low, '{CUE}')),
stated AS (
  SELECT doc_id, low, unnest(list_distinct([low] || blocks || told || [array_to_string(told, ' ')])) AS line FROM told),
counted AS (SELECT doc_id, whole, line, w, count(*) AS tf FROM (SELECT doc_id, line = low AS whole, line, unnest({split('line')}) AS w FROM stated) GROUP BY ALL),
weighed AS (SELECT c.*, tf * coalesce(idf.idf, ln(n + 1.0) + 1) AS x FROM counted c LEFT JOIN idf ON idf.w = c.w, n),
norms AS (SELECT doc_id, whole, line, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
cosines AS (
  SELECT doc_id, whole, line, t.i, t.licence, round(coalesce(dot, 0) / norm, 6) AS score FROM norms JOIN templates t ON true
  LEFT JOIN (SELECT g.doc_id, g.line, u.i, sum(g.x * u.x) AS dot FROM weighed g JOIN unit u ON u.w = g.w GROUP BY ALL) d USING (doc_id, line, i)),
files_told AS (SELECT doc_id, max(score) FILTER (WHERE whole) >= {THRESHOLD} AS is_file FROM cosines GROUP BY doc_id),
own AS (
  SELECT doc_id, is_file, score AS own_score, CASE WHEN score >= {THRESHOLD} THEN licence END AS own_licence
  FROM cosines JOIN files_told USING (doc_id) WHERE whole OR NOT is_file QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1),
judged AS (SELECT d.doc_id, dir, dir || '/' || name AS path, is_file, own_licence, own_score FROM docs d LEFT JOIN own ON own.doc_id = d.doc_id),
files AS (SELECT dir AS folder, own_licence AS dir_licence FROM judged WHERE is_file AND own_licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_licence) = 1),
nearest AS (
  SELECT j.dir AS below, folder AS near, dir_licence FROM (SELECT DISTINCT dir FROM judged) j JOIN files ON starts_with(j.dir || '/', folder || '/')
  QUALIFY row_number() OVER (PARTITION BY j.dir ORDER BY length(folder) DESC) = 1)
SELECT doc_id, path, own_licence, coalesce(own_score, 0.0) AS own_score, coalesce(own_licence, dir_licence) AS licence,
       CASE WHEN own_licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own_licence IS NULL THEN near END AS inherited_from
FROM judged LEFT JOIN nearest ON dir = below"""
