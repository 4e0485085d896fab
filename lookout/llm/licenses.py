"""Operator 6: license scans by sparse TF-IDF cosine and directory inheritance, DataFrame operations only.

Of documents that hold one of ``MARKERS``, three kinds of parts become sparse TF-IDF vectors and
are compared with templates by a join on shared tokens: header lines (those with a marker) with
one-line notices, runs of adjacent lines around them with the usual headers, and whole texts with
full licence texts.  A line's holder between "copyright" and "all rights reserved" is also tried
left out.  Document frequencies of the templates' tokens are counted over all documents; a token
that no template has counts as one of a single document, so foreign words lower the cosine.  A
document's own licence is that of its whole text, else of its best run or line; a named licence
goes before a mere copyright notice.  A document is a licence file if it is a whole licence text,
consists mostly of licence lines, or has a licence and the name of such a file: it speaks for
its directory, and documents without a licence of their own take that of their nearest ancestor
directory that has one.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Short licence notices as projects write them, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]
# The usual headers, as the licences' texts and publishers advise them.
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; "
_LATER = "either version {0} of the License, or (at your option) any later version."
_ONLY = "version {0}."
NOTICES = [
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    *(
        (name, f"This {kind} is free software; " + _GNU.format(full) + form.format(version))
        for name, kind, full, version in (
            ("GPL-2.0", "program", "General Public License", "2"),
            ("GPL-3.0", "program", "General Public License", "3"),
            ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
            ("LGPL-3.0", "library", "Lesser General Public License", "3"),
            ("AGPL-3.0", "program", "Affero General Public License", "3"),
        )
        for form in (_LATER, _ONLY)
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
]
#: Full licence texts, by SPDX identifier: the files of ``license_texts``.
TEXTS = [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
_LINE, _RUN, _TEXT = range(3)  # kinds of parts
#: A line is compared if it holds one of these, in lower case.
MARKERS = ("licen", "copyright", "public domain", "all rights reserved")
THRESHOLD = 0.7
#: A whole text must be closer than a line: long texts share their common words.
TEXT_THRESHOLD = 0.85
#: A document is a licence file if at least this share of its words is in licence lines.
FILE_SHARE = 0.5
#: Names of licence files.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying)([-_.][^/]*)?$"
#: Names a holder, not a licence.
NOTICE = "Proprietary"
#: Directory rows that are broadcast at most.
MAX_BROADCAST = 100_000


def _tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; digits keep inner dots."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}0-9]+(?:[.][0-9]+)*"), F.lit(0))


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _weights(df: DataFrame, keys: list[str], idf: DataFrame, rarest: float) -> DataFrame:
    """(keys, kind, token, x): unit-length TF-IDF vectors of the ``tokens`` column."""
    keys = [*keys, "kind"]
    terms = df.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    terms = terms.withColumn("short", F.col("kind") == _LINE).join(F.broadcast(idf), ["short", "token"], "left")
    terms = terms.withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    norms = terms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return terms.join(norms, keys).select(*keys, "token", (F.col("x") / F.col("norm")).alias("x"))


def _small(df: DataFrame) -> DataFrame:
    df = written(df, "directories")
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df.hint("merge")


def _values(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    body = [F.struct(F.lit(n).alias("variant"), F.lit(k).alias("kind"), F.lit(name).alias("license"), F.lit(text).alias("text")) for n, (k, name, text) in enumerate(rows)]
    return spark.range(1).select(F.inline(F.array(*body)))


def _marked(text: Column) -> Column:
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains(F.lower(text), F.lit(marker))
    return marked


def _part(kind: int, line: Column, content: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), content.alias("content"))


def _parts(text: Column) -> Column:
    """Marked lines, the same without holders, marked runs of adjacent lines with tokens, and the whole text."""
    lines = F.transform(F.split(text, "\n"), lambda x, n: _part(_LINE, n, x))
    lines = F.filter(lines, lambda x: _marked(x["content"]))
    bare = F.transform(lines, lambda x: _part(_LINE, x["line"], F.regexp_replace(x["content"], r"(?i)(copyright)\b.*\b(all rights reserved)", "$1 $2")))
    bare = F.array_except(bare, lines)
    runs = F.split(F.regexp_replace(text, r"\n[^\p{L}0-9]*\n", "\u0001"), "\u0001")
    runs = F.filter(F.array_distinct(runs), lambda x: F.contains(x, F.lit("\n")) & _marked(x))
    runs = F.transform(runs, lambda x: _part(_RUN, F.size(F.split(F.call_function("substring_index", text, x, F.lit(1)), "\n")) - 1, x))
    return F.concat(lines, bare, runs, F.array(_part(_TEXT, F.lit(0), text)))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "path",
    *,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """doc_id, path, license, score, line, is_license_file, inherited_license, inherited_from of every row.

    ``license`` is the row's own (null if none), ``line`` the number of its first line from 0;
    ``inherited_from`` is the directory whose licence applies where the row has none.  Of several
    licence files of a directory the one of the highest score speaks, then the lesser name.
    Null text has no licence; a null path is no directory's and inherits nothing; null ids and
    repeated rows are scanned like any row.  Other columns are ignored, whatever their names.
    ``templates`` are those of lines.  Empty input: empty result.
    """
    spark = docs.sparkSession
    templates = [(_LINE, *x) for x in templates or TEMPLATES] + [(_RUN, *x) for x in NOTICES] + [(_TEXT, *x) for x in TEXTS]
    templates = _values(spark, templates).select("variant", "kind", "license", _tokens(F.col("text")).alias("tokens"))
    words = templates.select((F.col("kind") == _LINE).alias("short"), F.explode("tokens").alias("token")).distinct().collect()
    vocabulary = sorted({r["token"] for r in words})
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")
    )
    known = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(_tokens(F.col("text")), known)).alias("token"))
    seen = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row a known token
    total = docs.count()
    rarest = math.log((1 + total) / 2) + 1
    idf = ", ".join(f"({r['short']}, '{r['token']}', CAST({math.log((1 + total) / (1 + seen.get(r['token'], 0))) + 1!r} AS DOUBLE))" for r in words)
    idf = spark.sql(f"SELECT * FROM VALUES {idf} AS t(short, token, idf)")

    chosen = docs.where(_marked(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    parts = chosen.select("row", "doc_id", "path", F.size(_tokens(F.col("text"))).alias("words"), F.posexplode(_parts(F.col("text"))).alias("part", "p"))
    parts = parts.select("row", "doc_id", "path", "words", "part", "p.kind", "p.line", _tokens(F.col("p.content")).alias("tokens"))
    parts = written(parts.where(F.size("tokens") > 0), "parts")
    mine = _weights(parts, ["row", "part"], idf, rarest)
    theirs = _weights(templates, ["variant", "license"], idf, rarest).select("variant", "license", "kind", "token", F.col("x").alias("y"))
    cosine = mine.join(F.broadcast(theirs), ["kind", "token"]).groupBy("row", "part", "kind", "variant", "license")
    cosine = cosine.agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    enough = F.when(F.col("kind") == _TEXT, F.lit(max(threshold, TEXT_THRESHOLD))).otherwise(F.lit(threshold))
    best = cosine.where(F.col("score") >= enough).groupBy("row", "part")
    best = best.agg(F.max(F.struct("score", -F.col("variant"), "license")).alias("top")).select("row", "part", "top.score", "top.license")
    hits = parts.select("row", "doc_id", "path", "words", "part", "kind", "line", F.size("tokens").alias("own")).join(best, ["row", "part"])
    whole = F.col("kind") == _TEXT
    rank = F.struct(F.round("score", 9).alias("score"), (-F.col("line")).alias("above"), "license")
    # a line and the same line without its holder are one line
    hits = hits.groupBy("row", "doc_id", "path", "words", "kind", "line").agg(F.max(rank).alias("top"), F.max("own").alias("own"))
    own = hits.groupBy("row", "doc_id", "path").agg(
        F.max(F.struct(F.col("top.license") != NOTICE, whole, "top.score", "top.above", "top.license")).alias("top"),
        F.greatest(*(F.sum(F.when(F.col("kind") == k, F.col("own")).otherwise(0)) for k in (_LINE, _RUN))).alias("own"),
        F.max("words").alias("words"),
        F.max(whole).alias("whole"),
    )
    is_file = F.col("whole") | (F.col("own") >= file_share * F.col("words")) | F.coalesce(F.rlike("path", F.lit(FILE_NAME)), F.lit(False))
    own = written(own.select("doc_id", "path", "top.score", (-F.col("top.above")).alias("line"), "top.license", is_file.alias("is_license_file")), "own")

    files = own.where("is_license_file and path is not null").select(parent(F.col("path")).alias("directory"), "score", "license", "path")
    speaks = files.groupBy("directory").agg(F.min(F.struct(-F.col("score"), "path", "license")).alias("top"))
    speaks = speaks.select(F.col("directory").alias("ancestor"), F.col("top.license").alias("inherited"))
    directories = docs.where("path is not null").select(parent(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = directories.select("directory", F.explode(F.array_distinct(chain)).alias("ancestor")).join(_small(speaks), "ancestor")
    nearest = above.groupBy("directory").agg(F.max(F.struct(F.length("ancestor"), "ancestor", "inherited")).alias("top"))
    nearest = _small(nearest.select("directory", F.col("top.ancestor").alias("from"), "top.inherited"))

    # rows that share id and path have one licence: that of their best line
    own = own.groupBy("doc_id", "path").agg(F.max(F.struct("score", -F.col("line"), "license", "is_license_file")).alias("top"))
    own = own.select(
        F.col("doc_id").alias("i"), F.col("path").alias("p"), "top.license", "top.score", (-F.col("top.col2")).alias("line"), "top.is_license_file"
    )
    rows = docs.select("doc_id", "path").join(own, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left")
    rows = rows.withColumn("directory", parent(F.col("path"))).join(nearest, "directory", "left")
    none = F.col("license").isNull()
    return rows.select(
        "doc_id",
        "path",
        "license",
        "score",
        "line",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.when(none, F.col("inherited")).alias("inherited_license"),
        F.when(none, F.col("from")).alias("inherited_from"),
    )
