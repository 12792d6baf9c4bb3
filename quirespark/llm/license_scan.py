"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A file's own licence is what its identifier lines say, by exact match of each identifier, or else that of the
nearest template.  A file's segments are its lines, runs of two to four lines, as wrapped headers are, and the sentences of
these; a licence file as a whole is one, too.  Each is a vector over terms (runs of a-z and 0-9 in lower
case, so that comment marks are no matter), weighted by how rarely documents hold a term; a term that
fewer than one in ``RAREST`` hold weighs as if so many did, so that verdicts don't move with the number of
documents.  Terms that no template has lengthen a vector as the rarest would.  A template is out of the
question for a segment that states versions, but not the template's, or that states none where there are several.  The nearest template, from
``threshold`` on, is the segment's licence; the nearest segment gives the file's.  A directory has the
licence of its licence file; a file without a notice of its own takes that of the nearest directory above
it that has one.

All of it is DataFrame operations.  By the Cauchy-Schwarz inequality a segment can reach the threshold
only if it holds one of a template's weightier terms, so all others are passed over by a regular
expression in the scan, without loss.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators.joins import join_counted

from .common import materialize

#: Wordings by which files state a licence, titles of licence texts, and identifiers.
NOTICES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-3.0", "Licensed under CC BY 3.0"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0"),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: The notice that sources under a licence of the GNU family bear, and which say which.
_GNU = (
    ("AGPL-3.0", "GNU Affero General Public License", "3"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
)
_GNU_NOTICES = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software"
    " Foundation, either version {} of the License, or (at your option) any later version",
    "under the terms of the {} as published by the Free Software Foundation, either version {} of the License",
    "you can redistribute it and/or modify it under the terms of the {} version {} as published by the Free Software Foundation",
)
IDENTIFIERS = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense",
)
#: Licence texts, for licence files as a whole.
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT"
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
    " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE"
    " OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = (
    ("BSD-2-Clause", _REDISTRIBUTION + _DISCLAIMER),
    (
        "BSD-3-Clause",
        _REDISTRIBUTION + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission." + _DISCLAIMER,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR"
        " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO"
        " EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING"
        " FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included"
        " in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR"
        " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
        " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE"
        " SOFTWARE.",
    ),
)


def _gnu_notices() -> tuple[tuple[str, str], ...]:
    return tuple((name, wording.format(title, version)) for name, title, version in _GNU for wording in _GNU_NOTICES)


#: Templates for segments, then those for licence files as a whole.
TEMPLATES = (NOTICES + _gnu_notices(), TEXTS)
#: A line with identifiers, which are taken as they are written, not compared by terms.
IDENTIFIER_LINE = "(?i)SPDX-License-Identifier:[ \\t]*([^\\r\\n]*)"
#: Numbers that are versions, and what there may be after a known identifier.
VERSIONS, LATER = r"(?:version|v\.?) *[0-9]+(?:\.[0-9]+)?|[0-9]+\.[0-9]+", r"(-only|-or-later|\+)$"
#: A notice of three clauses holds that of two.
WIDER, NARROWER = "BSD-2-Clause", "BSD-3-Clause"
THRESHOLD = 0.8
RAREST = 1000
WINDOW = 4  # lines of the longest run
SENTENCE_END = "[.;!?]+ +"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """A segment's terms in order, with repeats; there may be empty ones at the ends."""
    return F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")


def _terms(text: str) -> list[str]:
    plain = "".join(c if c in LOWER or c in "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER)))
    return plain.split()


class Space:
    """Terms' weights, and the templates' vectors of length 1, with their numbers."""

    def __init__(self, frequency: dict[str, int], documents: int, templates=TEMPLATES):
        weigh = lambda n: 1 - math.log(max((1 + n) / (1 + documents), 1 / RAREST))
        self.unseen = weigh(0)
        self.weight = {t: weigh(frequency.get(t, 0)) for kind in templates for _, text in kind for t in _terms(text)}
        self.vectors: list[list[tuple[int, str, dict[str, float]]]] = []
        number = 0
        for kind in templates:
            self.vectors.append([])
            for name, text in kind:
                terms = _terms(text)
                vector = {t: terms.count(t) * self.weight[t] for t in terms}
                length = math.sqrt(sum(v * v for v in vector.values()))
                self.vectors[-1].append((number, name, {t: v / length for t, v in vector.items()}))
                number += 1

    def needed(self, threshold: float, kind: int) -> str:
        """A pattern for terms of which a segment holds at least one if it is as near as ``threshold`` to a
        template of a kind (0: notices, 1: texts)."""
        found = set()
        for _, _, vector in self.vectors[kind]:
            light = 0.0
            for term, value in sorted(vector.items(), key=lambda x: (x[1], x[0])):
                light += value * value
                if light >= threshold * threshold * (1 - 1e-9):
                    found.add(term)
        first = lambda term: term[0]
        one_of = "|".join(f"{c}({'|'.join(t[1:] for t in terms)})" for c, terms in groupby(sorted(found), first))
        return f"(?i)(^|[^a-z0-9])({one_of})($|[^a-z0-9])"


def document_frequency(files: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many rows each template term occurs, over all of them, and how many rows there are."""
    wanted = sorted({t for kind in templates for _, text in kind for t in _terms(text)})
    held = F.array_intersect(terms_of(F.col("text")), F.array(*map(F.lit, wanted)))
    rows = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()  # a row a term
    counts = {r["term"]: r["count"] for r in rows}
    return counts, counts.pop("", 0)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows, as long as the templates, made by the JVM from one literal."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(listed))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where functions of array elements within ``body`` don't compute ``value`` again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def segments_of(text: Column, notice: str) -> Column:
    """Runs of one to four lines, and their sentences, that match ``notice``; there may be repeats."""

    def runs(both: Column) -> Column:
        lines, matched = both["lines"], both["matched"]
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.array_contains(F.slice(matched, i, WINDOW), True))
        several = lambda i: F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda n: F.array_join(F.slice(lines, i, n), " "))
        return F.flatten(F.transform(starts, several))

    def marked(lines: Column) -> Column:
        return F.struct(lines.alias("lines"), F.transform(lines, lambda line: line.rlike(notice)).alias("matched"))

    with_sentences = lambda found: F.concat(found, F.flatten(F.transform(found, lambda run: F.split(run, SENTENCE_END))))
    every = _with(_with(_with(F.split(text, "\n"), marked), runs), with_sentences)
    return F.filter(F.array_distinct(every), lambda segment: segment.rlike(notice) & ~segment.rlike(IDENTIFIER_LINE))


def _versions(segment: Column) -> Column:
    """The versions that a segment states, each with one point at least."""
    stated = F.regexp_extract_all(F.translate(segment, UPPER, LOWER), F.lit(VERSIONS), F.lit(0))
    plain = F.transform(stated, lambda v: F.regexp_extract(v, r"[0-9.]*[0-9]$", 0))
    return F.transform(plain, lambda v: F.when(F.contains(v, F.lit(".")), v).otherwise(F.concat(v, F.lit(".0"))))


def _version_of(name: str) -> str | None:
    last = name.rpartition("-")[2]
    return last if last.replace(".", "").isdigit() else None


def _several(templates) -> set[str]:
    """Licences of which the templates know several versions, so that a segment must state its own."""
    names = {name for kind in templates for name, _ in kind if _version_of(name)}
    kinds = [name.rpartition("-")[0] for name in names]
    return {name for name in names if kinds.count(name.rpartition("-")[0]) > 1}


def _identified(text: Column) -> Column:
    """A licence for each identifier line of a text that has known ones: in order of name, with what stands between."""
    known = F.array(*map(F.lit, IDENTIFIERS))

    def licence(line: Column) -> Column:
        named = F.transform(F.regexp_extract_all(line, F.lit("[A-Za-z0-9.+-]+"), F.lit(0)), lambda t: F.regexp_replace(t, LATER, ""))
        names = F.array_sort(F.array_intersect(named, known))
        return F.when(line.rlike(r"\bOR\b"), F.array_join(names, " OR ")).otherwise(F.array_join(names, " AND "))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER_LINE), F.lit(1)), licence), lambda name: name != "")


def _directory(path: Column) -> Column:
    """What stands before the last slash; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         templates=TEMPLATES) -> DataFrame:
    """``doc_id, path, license, score, origin, inherited_from`` for each row of ``files``.

    ``origin`` is ``notice`` (the file's own, ``score`` its cosine, or 1 of an identifier), ``inherited`` or ``none``.
    An identifier line with several gives them all (``Apache-2.0 OR MIT``); unknown ones are left out.  Of
    equally near templates the first by name, of several licence files of a directory the nearest, then
    the first by path, counts; a licence file's text as a whole counts as a segment, too.  Null texts
    count as empty; rows without a path have no licence; repeated rows, and rows of one path, share
    what was found for the path; an empty table gives no rows; further columns are ignored.
    """
    spark = files.sparkSession
    rows = files.select(
        F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    space = Space(*document_frequency(rows, templates), templates)
    notice, whole = space.needed(threshold, 0), space.needed(threshold, 1)
    noticed, licensed_as_a_whole = F.col("text").rlike(notice), F.col("path").rlike(LICENCE_FILE) & F.col("text").rlike(whole)
    stated = F.col("text").rlike(IDENTIFIER_LINE)
    segments = F.array_union(
        F.when(F.col("noticed"), segments_of(F.col("text"), notice)).otherwise(F.array().cast("array<string>")),
        F.when(F.col("path").rlike(LICENCE_FILE) & ~F.col("stated"), F.array("text")).otherwise(F.array().cast("array<string>")),
    )
    near = rows.where(F.col("path").isNotNull()).withColumns({"noticed": noticed, "stated": stated}).where(F.col("noticed") | F.col("stated") | licensed_as_a_whole)
    whole_names = F.when(F.col("stated"), _identified(F.col("text"))).otherwise(F.array().cast("array<string>"))
    # An identifier's segment is its licence, of score 1.
    both_kinds = F.concat(
        F.transform(segments, lambda x: F.struct(x.alias("segment"), F.lit(None).cast("string").alias("license"))),
        F.transform(whole_names, lambda x: F.struct(F.lit(None).cast("string").alias("segment"), x.alias("license"))),
    )
    cut = near.select("path", F.inline(both_kinds)).distinct().withColumn("number", F.monotonically_increasing_id())
    cut = materialize(cut, "segments")

    # Few segments are left; their terms are counted and weighed.  Rows carry a segment's number, not its text.
    weights = _table(spark, [{"term": t, "weight": w} for t, w in sorted(space.weight.items())], "term string, weight double")
    several = _several(templates)
    vectors = _table(
        spark,
        [
            {"term": t, "template": number, "license": name, "version": _version_of(name), "several": name in several, "narrows": kind == 0 and name == NARROWER, "value": v}
            for kind, found in enumerate(space.vectors) for number, name, vector in found for t, v in vector.items()
        ],
        "term string, template int, license string, version string, several boolean, narrows boolean, value double",
    )
    counted = (
        cut.select("number", F.explode(terms_of(F.col("segment"))).alias("term")).where("term <> ''")
        .groupBy("number", "term").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(weights), "term", "left")  # as long as the templates
        .select("number", "term", (F.col("n") * F.coalesce("weight", F.lit(space.unseen))).alias("w"))
    )
    lengths = counted.groupBy("number").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = counted.join(F.broadcast(vectors), "term").groupBy("number", "template", "license", "version", "several", "narrows").agg(F.sum(F.col("w") * F.col("value")).alias("dot"))
    placed = cut.where("segment is not null").select("number", "path", _versions(F.col("segment")).alias("versions"))
    fits = F.col("version").isNull() | (F.size("versions") == 0) & ~F.col("several") | F.array_contains("versions", F.col("version"))
    cosines = dots.join(lengths, "number").join(placed, "number").where(fits).select("path", "license", "narrows", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    said = cut.where("license is not null").select("path", "license", (F.col("license") == NARROWER).alias("narrows"), F.lit(1.0).alias("score"))
    found = cosines.where(F.col("score") >= threshold).unionByName(said)
    order = F.struct(-F.col("score"), F.col("license"))
    best = F.min_by(F.struct("license", "score"), order)
    narrow = F.min_by(F.struct("license", "score"), F.when(F.col("license") != WIDER, order))  # rows without an order are passed over
    own = F.when(F.max("narrows"), narrow).otherwise(best)
    own = materialize(found.groupBy("path").agg(own.alias("own")), "own")

    # Directories: those with a licence file, and for every directory with files the nearest of them above.
    licence_files = own.where(F.col("path").rlike(LICENCE_FILE)).withColumn("directory", _directory(F.col("path")))
    nearest = F.min_by(F.col("own.license"), F.struct(-F.col("own.score"), F.col("path")))
    licensed = licence_files.where("directory is not null").groupBy("directory").agg(nearest.alias("license"))
    places = materialize(rows.select("doc_id", "path", _directory(F.col("path")).alias("directory")), "places")
    used = places.where("directory is not null").groupBy("directory").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    up = used.select("directory", "n", F.explode(above).alias("a")).select("directory", "n", "a.depth", "a.above")
    inherited = (
        up.join(licensed.withColumnRenamed("directory", "above"), "above")
        .groupBy("directory").agg(F.max("n").alias("n"), F.max_by(F.struct("license", F.col("above").alias("inherited_from")), "depth").alias("from_above"))
    )
    total = places.count()
    passed_on = join_counted(places, materialize(inherited, "inherited"), "directory", total).select("path", "from_above").distinct()
    both = (
        places.select("doc_id", "path")
        .join(own.withColumnRenamed("path", "own_path"), F.col("path") == F.col("own_path"), "left")
        .join(passed_on.withColumnRenamed("path", "up_path"), F.col("path") == F.col("up_path"), "left")
    )
    has_own, has_above = F.col("own").isNotNull(), F.col("from_above").isNotNull()
    return both.select(
        "doc_id",
        "path",
        F.coalesce("own.license", "from_above.license").alias("license"),
        F.col("own.score").alias("score"),
        F.when(has_own, "notice").when(has_above, "inherited").otherwise("none").alias("origin"),
        F.when(~has_own, F.col("from_above.inherited_from")).alias("inherited_from"),
    )


def oracle_sql(files: str, threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """DuckDB SQL for the rows of ``scan`` over ``files``, a query of ``doc_id, path, text``."""
    both = [row for kind in templates for row in kind]
    quoted = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(both))
    terms = lambda x: f"regexp_split_to_array(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')"
    file_like = LICENCE_FILE
    identifiers, several = (", ".join(f"'{i}'" for i in names) for names in (IDENTIFIERS, sorted(_several(templates))))
    return f"""
WITH files AS ({files}),
templates(template, license, wording) AS (VALUES {quoted}),
template_terms AS (
  SELECT template, license, term, count(*) AS n
  FROM (SELECT template, license, unnest({terms("wording")}) AS term FROM templates) WHERE term <> '' GROUP BY ALL
),
total AS (SELECT count(*) AS documents FROM files),
wanted AS (SELECT DISTINCT term FROM template_terms),
frequency AS (
  SELECT term, count(*) AS n
  FROM (SELECT unnest(list_distinct({terms("coalesce(text, '')")})) AS term FROM files) JOIN wanted USING (term) GROUP BY term
),
weights AS (
  SELECT term, 1 - ln(greatest((1 + coalesce(n, 0)) / (1 + documents), 1 / {RAREST})) AS weight FROM wanted LEFT JOIN frequency USING (term), total
),
vectors AS (
  SELECT template, license, term, n * weight / sqrt(sum((n * weight) ** 2) OVER (PARTITION BY template)) AS value
  FROM template_terms JOIN weights USING (term)
),
lines AS (SELECT path, string_split(coalesce(text, ''), chr(10)) AS lines FROM files WHERE path IS NOT NULL),
starts AS (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS i FROM lines),
runs AS (
  SELECT DISTINCT path, array_to_string(lines[i:i + n - 1], ' ') AS run FROM starts, range(1, {WINDOW + 1}) AS sizes(n)
),
segments AS (
  SELECT DISTINCT path, segment FROM (
    SELECT path, unnest(list_prepend(run, regexp_split_to_array(run, '{SENTENCE_END}'))) AS segment FROM runs
    UNION ALL
    SELECT path, coalesce(text, '') FROM files WHERE regexp_matches(path, '{file_like}')
  ) WHERE path IS NOT NULL AND (segment = '' OR NOT regexp_matches(segment, '{IDENTIFIER_LINE}') OR path IN (SELECT path FROM files WHERE text = segment))
),
stated AS (
  SELECT DISTINCT path, CASE WHEN regexp_matches(line, '(^|[^A-Za-z0-9_])OR([^A-Za-z0-9_]|$)') THEN array_to_string(names, ' OR ') ELSE array_to_string(names, ' AND ') END AS license
  FROM (
    SELECT path, line, list_sort(list_distinct(list_filter(
      list_transform(regexp_extract_all(line, '[A-Za-z0-9.+-]+'), lambda t: regexp_replace(t, '{LATER}', '')), lambda t: list_contains([{identifiers}], t)))) AS names
    FROM (SELECT path, unnest(regexp_extract_all(text, '{IDENTIFIER_LINE}', 1)) AS line FROM files WHERE path IS NOT NULL)
  )
),
counted AS (
  SELECT path, segment, term, count(*) AS n
  FROM (SELECT path, segment, unnest({terms("segment")}) AS term FROM segments) WHERE term <> '' GROUP BY ALL
),
weighed AS (
  SELECT path, segment, term, n * coalesce(weight, 1 - ln(greatest(1 / (1 + documents), 1 / {RAREST}))) AS w
  FROM counted LEFT JOIN weights USING (term), total
),
lengths AS (SELECT path, segment, sqrt(sum(w * w)) AS length FROM weighed GROUP BY ALL),
dots AS (
  SELECT path, segment, template, license, sum(w * value) AS dot FROM weighed JOIN vectors USING (term) GROUP BY ALL
),
versions AS (
  SELECT path, segment, list_transform(regexp_extract_all(translate(segment, '{UPPER}', '{LOWER}'), '{VERSIONS}'),
    lambda v: CASE WHEN contains(v, '.') AND regexp_matches(v, '[0-9][.][0-9]+$') THEN regexp_extract(v, '[0-9]+[.][0-9]+$') ELSE regexp_extract(v, '[0-9]+$') || '.0' END) AS versions
  FROM segments
),
cosines AS (
  SELECT path, license, template < {len(templates[0])} AND license = '{NARROWER}' AS narrows, round(dot / length, 6) AS score
  FROM dots JOIN lengths USING (path, segment) JOIN versions USING (path, segment)
  WHERE round(dot / length, 6) >= {threshold}
    AND (NOT regexp_matches(license, '-[0-9.]+$') OR len(versions) = 0 AND NOT list_contains([{several}], license)
         OR list_contains(versions, regexp_extract(license, '-([0-9.]+)$', 1)))
  UNION ALL SELECT path, license, license = '{NARROWER}', 1.0 FROM stated WHERE license <> ''
),
own AS (
  SELECT path, license, score FROM (SELECT *, bool_or(narrows) OVER (PARTITION BY path) AS narrow FROM cosines)
  WHERE NOT (narrow AND license = '{WIDER}')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1
),
licensed AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS directory, license FROM own
  WHERE regexp_matches(path, '{file_like}') AND contains(path, '/')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) = 1
),
places AS (
  SELECT doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS directory FROM files
),
inherited AS (
  SELECT p.directory, l.license, l.directory AS inherited_from
  FROM (SELECT DISTINCT directory FROM places WHERE directory IS NOT NULL) p
  JOIN licensed l ON starts_with(p.directory || '/', l.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY p.directory ORDER BY length(l.directory) DESC) = 1
)
SELECT doc_id, p.path, coalesce(o.license, i.license) AS license, o.score AS score,
       CASE WHEN o.path IS NOT NULL THEN 'notice' WHEN i.directory IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.path IS NULL THEN i.inherited_from END AS inherited_from
FROM places p LEFT JOIN own o ON p.path = o.path LEFT JOIN inherited i ON p.directory = i.directory
"""
