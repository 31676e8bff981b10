"""Operator 4: licence scan, with DataFrame functions only.

Header lines and paragraphs that speak of a licence are compared one by one with templates (notices,
titles and paragraphs of licences) by the cosine of sparse TF-IDF vectors.  A licence file is one that is
called so, or mostly such lines; files without a header inherit from the nearest ancestor directory that
has one, by joins on paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Templates (id, notice): fixed texts of the licences.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal public domain dedication"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that name a licence or change what it grants (fixed values).  A text with one that a template has in none of its notices is not that
#: licence, however alike, and neither is one that lacks one that the notice has.
NAMING = ["affero", "agpl", "alike", "apache", "boost", "bsd", "cc", "cc0", "commercial", "commons", "creative", "derivatives", "documentation", "eclipse", "gnu", "gpl", "isc", "lesser", "lgpl", "library", "mit", "mozilla", "mpl", "nc", "nd", "noderivatives", "noncommercial", "proprietary", "sa", "sharealike", "unlicense"]
#: The identifier of a file's licence, which says what it says: the first such line counts.
SPDX, SPDX_LINE = r"(?i)spdx-license-identifier:[ \t]*([A-Za-z0-9.+() -]+)", "(?i)spdx-license-identifier"
SPDX_WORDS, SPDX_SUFFIX = ["", "and", "or"], r"(-only|-or-later|\+)$"
#: Least cosine of a match; least share of a licence file's characters in its header lines, unless its name tells.
LEAST, FILE_SHARE = 0.6, 0.5
LICENCE_NAME = "(?i)(^|/)(un)?(licen[cs]e|copying)([.-][^/]*)?$"
HEADER = "(?i)licen[sc]e|copyright|spdx|released |permission|redistribut|creative commons"
SPEAKS = " OR ".join(f"lower(text) LIKE '%{x}%'" for x in ("licen_e", "copyright", "spdx", "released ", "permission", "redistribut", "creative commons"))
WORD, BETWEEN, PARAGRAPH = "[a-z0-9]+", "[^a-z0-9]+", "\n[ \t\r]*\n"


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, notice in templates for w in re.findall(WORD, notice.lower())})


def needed(notice: str) -> list[str]:
    """Words that a text must have to be this notice: those of NAMING in it, and its version (the first number of one or two digits)."""
    own = re.findall(WORD, notice.lower())
    return sorted({w for w in own if w in NAMING} | set([w for w in own if re.fullmatch("[0-9]{1,2}", w)][:1]))


def allowed(templates: list[tuple[str, str]], template: str) -> list[str]:
    return sorted({w for t, notice in templates if t == template for w in needed(notice) if w in NAMING})


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def directory(path: str) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherited(files: DataFrame, places: DataFrame) -> DataFrame:
    """(dir, ancestor, found): for each directory of files (path) the nearest ancestor, or itself, of places
    (ancestor, found)."""
    dirs = files.where("path is not null").select(directory("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("ancestor"))
    nearest = F.max(F.struct(F.length("ancestor").alias("l"), "ancestor", "found"))
    return up.join(places, "ancestor").groupBy("dir").agg(nearest.alias("b")).select("dir", "b.ancestor", "b.found")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per row of files (doc_id, path, text): doc_id, path, declared, score, is_licence_file, licence,
    inherited_from (a directory, if so).

    templates: (template, notice), a short list; a template has any number of notices.  Words are letters
    and digits in lower case.  A word's idf is ln((1 + N) / (1 + df)) + 1, of the N files df having it; a
    word of no notice counts with the mean idf of the notices' words.  Each line and each paragraph that
    speaks of a licence is a vector of its own; the best cosine of a file's wins, ties by template; below
    `least` nothing is declared, nor by a notice of which the text lacks a word of NAMING or the version, nor by a template that has
    in no notice a word of NAMING that the text has.  A line with an SPDX identifier is no vector: the first one of a file declares its
    licence, with score 1, if it is a template's (with -only, -or-later or + too), the whole expression if all of its are, and else that none
    of the templates' is declared.  Of several licence files in one directory the best score counts, then
    the least path.

    Null or empty text has no header; a null path is in no directory and inherits nothing.  Rows are
    independent and give a row each, repeated or not.  Texts of any length are whole.  Extra columns are
    ignored, an empty table gives no rows.  Only the notices' words are counted over all files."""
    spark = files.sparkSession
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = vocabulary(templates)
    # All of these have a row for each word of the templates, or of a notice, at most.
    total = files.count()
    held = files.select(F.explode(F.array_intersect(words(F.col("text")), F.lit(own))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = spark.createDataFrame([(w,) for w in own], "w string").join(held, "w", "left")
    idf = staged(df.select("w", (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), "idf")
    other = idf.agg(F.avg("idf")).first()[0]
    notices = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(templates)], "notice int, template string, text string")
    demands = spark.createDataFrame([(k, needed(n), allowed(templates, t)) for k, (t, n) in enumerate(templates)], "notice int, need array<string>, may array<string>")
    telling = sorted({*NAMING, *(w for _, n in templates for w in needed(n))})
    weights = notices.select("notice", "template", F.explode(words(F.col("text"))).alias("w")).groupBy("notice", "template", "w").agg(F.count("*").alias("tf"))
    weights = weights.join(idf, "w").withColumn("v", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("notice").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vectors = weights.join(norms, "notice").select("notice", "template", "w", (F.col("v") / F.col("norm")).alias("v"))

    speaks = lambda parts: F.filter(parts, lambda part: part.rlike(HEADER) & ~part.rlike(SPDX_LINE))
    lines = speaks(F.split("text", "\n"))
    units = F.array_distinct(F.concat(lines, speaks(F.split("text", PARAGRAPH))))
    mostly = F.length(F.array_join(lines, "")) / F.length("text") >= FILE_SHARE
    spoken = F.coalesce(F.expr(SPEAKS), F.lit(False))
    said = F.trim(F.regexp_extract("text", SPDX, 1))
    ids = F.filter(F.split(F.lower("said"), "[() ]+"), lambda w: ~w.isin(SPDX_WORDS))
    names = sorted({t for t, _ in templates})
    known = F.transform(ids, lambda w: F.element_at(F.create_map(*[F.lit(x) for t in names for x in (t.lower(), t)]), F.regexp_replace(w, SPDX_SUFFIX, "")))
    heads = files.where(spoken).select("doc_id", "path", (mostly | F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False))).alias("named"), units.alias("units"), F.col("text").rlike(SPDX_LINE).alias("spdx"), said.alias("said"))
    heads = heads.withColumn("known", known).withColumn("stated", F.when((F.size("known") > 0) & F.forall("known", lambda k: k.isNotNull()), F.when(F.size("known") == 1, F.col("known")[0]).otherwise(F.col("said")))).drop("known", "said")
    heads = staged(heads.withColumn("row", F.monotonically_increasing_id()), "headers")  # so texts are read once more, and rows have a key
    counted = heads.select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", F.explode(words(F.col("u"))).alias("w")).groupBy("row", "unit", "w").agg(F.count("*").alias("tf"))
    counted = staged(counted.join(F.broadcast(idf), "w", "left").select("row", "unit", "w", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("x")), "counted")
    length = counted.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.collect_set(F.when(F.col("w").isin(telling), F.col("w"))).alias("have"))
    dots = counted.join(F.broadcast(vectors), "w").groupBy("row", "unit", "notice", "template").agg(F.sum(F.col("x") * F.col("v")).alias("dot"))
    scored = dots.join(length, ["row", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= least)
    scored = scored.join(F.broadcast(demands), "notice").where((F.size(F.array_except("need", "have")) == 0) & (F.size(F.array_except(F.array_intersect("have", F.lit(NAMING)), "may")) == 0))
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b")).select("row", F.col("b.template").alias("declared"), (-F.col("b.s")).alias("score"))
    declared = heads.drop("units").join(best, "row", "left").withColumn("declared", F.when(F.col("spdx"), F.col("stated")).otherwise(F.col("declared"))).withColumn("score", F.when(F.col("spdx"), F.when(F.col("stated").isNotNull(), 1.0)).otherwise(F.col("score")))
    declared = declared.select("doc_id", "path", "declared", "score", (F.col("named") & F.col("declared").isNotNull()).alias("is_licence_file"))
    declared = staged(declared, "declared")

    places = declared.where("is_licence_file and path is not null").select(directory("path").alias("ancestor"), F.struct((-F.col("score")).alias("s"), "path", "declared").alias("b"))
    near = inherited(files, places.groupBy("ancestor").agg(F.min("b").alias("b")).select("ancestor", F.col("b.declared").alias("found")))
    silent = files.where(~spoken).select("doc_id", "path", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_licence_file"))
    out = declared.union(silent).withColumn("dir", directory("path")).join(near, "dir", "left")
    inherits = F.col("declared").isNull() & F.col("found").isNotNull()
    return out.select("doc_id", "path", "declared", "score", "is_licence_file", F.coalesce("declared", "found").alias("licence"), F.when(inherits, F.col("ancestor")).alias("inherited_from"))


#: Documents as files: a directory for each source, one for each 10,000 ids in it, one for each 100.
PATH = "concat(coalesce(source, 'unknown'), '/', cast(doc_id div 10000 as string), '/', cast(doc_id div 100 as string), '/', cast(doc_id as string), '.txt')"


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), "text"))


def sql() -> str:
    """The same as DuckDB SQL."""
    quoted = lambda ws: "([" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[])"
    demands = ", ".join(f"({k}, {quoted(needed(n))}, {quoted(allowed(TEMPLATES, t))})" for k, (t, n) in enumerate(TEMPLATES))
    names = sorted({t for t, _ in TEMPLATES})
    values = ", ".join("({}, '{}', '{}')".format(k, t, n.replace("'", "''")) for k, (t, n) in enumerate(TEMPLATES))
    paragraph = r"\n[ \t\r]*\n"
    return f"""
WITH files AS (SELECT doc_id, text, concat(coalesce(source, 'unknown'), '/', CAST(doc_id // 10000 AS VARCHAR), '/', CAST(doc_id // 100 AS VARCHAR), '/', CAST(doc_id AS VARCHAR), '.txt') AS path FROM documents),
total AS (SELECT count(*) AS n FROM files),
templates(notice, template, text) AS (VALUES {values}),
demands(notice, need, may) AS (VALUES {demands}),
tw AS (SELECT notice, template, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM templates),
held AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS w FROM files) WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT v.w, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM tw) v CROSS JOIN total LEFT JOIN held ON held.w = v.w),
other AS (SELECT avg(idf) AS other FROM idf),
weights AS (SELECT notice, template, w, count(*) * any_value(idf) AS v FROM tw JOIN idf USING (w) GROUP BY notice, template, w),
norms AS (SELECT notice, sqrt(sum(v * v)) AS norm FROM weights GROUP BY notice),
vectors AS (SELECT notice, template, w, v / norm AS v FROM weights JOIN norms USING (notice)),
heads AS (SELECT doc_id, path, length(text) AS n_chars,
                 list_filter(string_split(text, chr(10)), lambda part: regexp_matches(part, '{HEADER}') AND NOT regexp_matches(part, '{SPDX_LINE}')) AS lines,
                 list_filter(string_split_regex(text, '{paragraph}'), lambda part: regexp_matches(part, '{HEADER}') AND NOT regexp_matches(part, '{SPDX_LINE}')) AS paragraphs, regexp_matches(text, '{SPDX_LINE}') AS spdx, trim(regexp_extract(text, '{SPDX}', 1)) AS said
          FROM files WHERE {SPEAKS}),
marked AS (SELECT doc_id, path, spdx, said, list_transform(list_filter(string_split_regex(lower(said), '[() ]+'), lambda w: w NOT IN ('', 'and', 'or')), lambda w: {quoted(names)}[list_position({quoted([n.lower() for n in names])}, regexp_replace(w, '{SPDX_SUFFIX}', ''))]) AS known, list_distinct(list_concat(lines, paragraphs)) AS units,
                  length(array_to_string(lines, '')) / n_chars >= {FILE_SHARE} OR regexp_matches(path, '{LICENCE_NAME}') AS named FROM heads),
parts AS (SELECT doc_id, unnest(units) AS u FROM marked),
unit AS (SELECT DISTINCT doc_id, u FROM parts),
counted AS (SELECT doc_id, u, w, count(*) AS tf FROM (SELECT doc_id, u, unnest(regexp_extract_all(lower(u), '{WORD}')) AS w FROM unit) GROUP BY ALL),
x AS (SELECT doc_id, u, c.w, tf * coalesce(idf, other) AS x FROM counted c LEFT JOIN idf ON c.w = idf.w CROSS JOIN other),
lens AS (SELECT doc_id, u, sqrt(sum(x * x)) AS length, list(w) AS have FROM x GROUP BY ALL),
dots AS (SELECT doc_id, u, notice, template, sum(x * v) AS dot FROM x JOIN vectors USING (w) GROUP BY ALL),
scored AS (SELECT doc_id, template, round(dot / length, 6) AS score FROM dots JOIN lens USING (doc_id, u) JOIN demands USING (notice) WHERE list_has_all(have, need) AND list_has_all(may, list_intersect(have, {quoted(NAMING)}))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS r FROM scored WHERE score >= {LEAST}),
best AS (SELECT doc_id, template, score FROM ranked WHERE r = 1),
stated AS (SELECT m.doc_id, path, named, spdx, CASE WHEN len(known) > 0 AND len(list_filter(known, lambda k: k IS NULL)) = 0 THEN CASE WHEN len(known) = 1 THEN known[1] ELSE said END END AS stated, template, score FROM marked m LEFT JOIN best USING (doc_id)),
declared AS (SELECT doc_id, path, declared, score, named AS is_licence_file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM (SELECT doc_id, path, named, CASE WHEN spdx THEN stated ELSE template END AS declared, CASE WHEN spdx THEN 1.0 ELSE score END AS score FROM stated) WHERE declared IS NOT NULL),
places AS (SELECT dir AS ancestor, declared AS found FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS r FROM declared WHERE is_licence_file) WHERE r = 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
up AS (SELECT dir, array_to_string(string_split(dir, '/')[1:i], '/') AS ancestor FROM dirs, generate_series(0, 3) g(i)),
near AS (SELECT dir, ancestor, found FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY length(ancestor) DESC) AS r FROM up JOIN places USING (ancestor)) WHERE r = 1)
SELECT f.doc_id, f.path, d.declared, d.score, coalesce(d.is_licence_file, false) AS is_licence_file, coalesce(d.declared, near.found) AS licence,
       CASE WHEN d.declared IS NULL THEN near.ancestor END AS inherited_from
FROM files f LEFT JOIN declared d USING (doc_id) LEFT JOIN near ON near.dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
"""
