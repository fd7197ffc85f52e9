"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance
from the nearest ancestor directory (DataFrame functions only).

A file's units are its lines that speak of licensing, and, for a licence file (by its name), its
whole text too. Beside them, every licensing word of a text gives windows as long as the templates, with
the word where a template has it, so that a sentence inside a longer line or over several lines is
found; a window counts for a licence that it names. Units are collapsed to distinct ones before anything is scored, so a header that a
third of all files carry is scored once. Term weights are (1 + ln tf) * idf, with idf over the
template collection; a term of no template has the greatest idf. A file's own licence is its
best unit's best template at THRESHOLD or above. A directory's licence is that of its best
licence file, and a file without its own takes the nearest ancestor directory's.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

THRESHOLD = 0.6
HEADER = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
WORD = "[a-z0-9]+"
#: Titles and notices of well-known licences, versions apart, by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Artistic-1.0", "The Artistic License Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]

#: What a window must hold (as words parted by single spaces) to count for a licence of the family.
NAMED = {"AGPL": "agpl|affero general public", "Apache": "apache", "Artistic": "artistic license", "BSD": "bsd|redistribution and use", "CC-BY": "creative commons|cc by", "CC0": r"\bcc0\b|copyright and related rights",
         "EPL": "epl|eclipse public", "GFDL": "gfdl|free documentation license", "GPL": "gpl|general public license", "ISC": r"\bisc\b|hereby granted provided that", "LGPL": "lgpl|lesser general public|library general public",
         "MIT": r"\bmit\b|permission is hereby granted", "MPL": "mpl|mozilla public"}
_CC = r"(cc by|creative commons attribution)"
_GPL = r"(gpl ?|general public license)( \w+){0,10}? ?v?"
#: Licences whose words are close to a template's: (template's licence, words that show the template's own, [(words, licence)]).
#: The first that is found counts, unless the template's own words are there too.
VARIANTS = [
    ("GPL-3.0", r"(?<!lesser )(?<!affero )(?<!\w)" + _GPL + r"3\b", [
        (r"affero|agpl", "AGPL-3.0"), (r"(lesser|lgpl)( \w+){0,16}? ?v?2 1\b", "LGPL-2.1"), (r"lesser|lgpl", "LGPL-3.0"), (r"library general public", "LGPL-2.0"),
        (_GPL + r"2\b", "GPL-2.0"), (_GPL + r"1\b", "GPL-1.0")]),
    *[(x, own, [(rf"{_CC} {words}( international| unported| generic| license)*( {v} {m})?\b" if (v, m) == ("4", "0") else rf"{_CC} {words}( international| unported| generic| license)* {v} {m}\b", f"CC-BY{tag}-{v}.{m}")
                for words, tag in (("(nc|noncommercial|non commercial) (sa|sharealike|share alike)", "-NC-SA"), ("(nc|noncommercial|non commercial) (nd|noderivatives|noderivs|no derivatives)", "-NC-ND"),
                                   ("(sa|sharealike|share alike)", "-SA"), ("(nd|noderivatives|noderivs|no derivatives)", "-ND"), ("(nc|noncommercial|non commercial)", "-NC"))
                for v, m in ("10", "20", "25", "30", "40")] + [(rf"{_CC} {v} {m}\b", f"CC-BY-{v}.{m}") for v, m in ("10", "20", "25", "30")])
      for x, own in (("CC-BY-4.0", rf"{_CC}( international)? 4 0\b"), ("CC-BY-NC-4.0", rf"{_CC} (nc|noncommercial|non commercial)( international)? 4 0\b"))],
    ("Apache-2.0", r"apache( software)?( license)?( version)? v?2\b", [(r"apache( software)?( license)?( version)? v?1 1\b", "Apache-1.1"), (r"apache( software)?( license)?( version)? v?1\b", "Apache-1.0")]),
    ("MPL-2.0", r"(mpl|mozilla public license)( version)?( v)? ?v?2\b", [(r"(mpl|mozilla public license)( version)?( v)? ?v?1 1\b", "MPL-1.1"), (r"(mpl|mozilla public license)( version)?( v)? ?v?1\b", "MPL-1.0")]),
    ("BSD-3-Clause", r"bsd 3|3 clause", [(r"bsd 2|2 clause bsd", "BSD-2-Clause"), (r"bsd 4|4 clause bsd", "BSD-4-Clause"), (r"\b0bsd|bsd 0|bsd zero", "0BSD")]),
    ("MIT", r"\bmit license", [(r"\bmit 0\b|mit no attribution", "MIT-0")]),
]


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


LICENSING = "licen[cs]e|copyright|spdx|hereby|redistribution"
#: How far words of a window lie from its licensing word, at most.
REACH = max(len(_words(t)) for _, t in TEMPLATES)


def named(licence: Column, words: Column) -> Column:
    out = F.lit(False)
    for x, pattern in NAMED.items():
        out = out | (licence.rlike(f"^{x}(-|$)") & words.rlike(pattern))
    return out


def stated(licence: Column, words: Column) -> Column:
    """The template's licence, or the close one that the words state instead."""
    out = licence
    for x, own, others in VARIANTS:
        found = F.coalesce(*[F.when(words.rlike(p), F.lit(to)) for p, to in others])
        out = F.when((licence == x) & ~words.rlike(own), F.coalesce(found, licence)).otherwise(out)
    return out


def window_contexts(texts: DataFrame) -> DataFrame:
    """(row, text) to (row, context, hit): the words around each licensing word and which of them that is.
    The words are a generated column, so that they are made once a text and not once a word of it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    made = texts.select("row", F.explode(F.array(words)).alias("words"))
    hits = F.filter(F.transform("words", lambda x, i: F.when(x.rlike(LICENSING), i)), lambda i: i.isNotNull())
    at = made.select("row", "words", hits.alias("hits"))
    from_ = lambda i: F.greatest(i - REACH, F.lit(0))
    around = F.transform("hits", lambda i: F.struct(F.array_join(F.slice("words", from_(i) + 1, 2 * REACH + 1), " ").alias("context"), (i - from_(i)).alias("hit")))
    return at.select("row", F.explode(F.array_distinct(around)).alias("c")).select("row", "c.context", "c.hit")


def adding(weights: Column):
    return lambda total, term: total + F.element_at(weights, term)


def windows() -> Column:
    """Of a context: for each template and licensing word of it the window as long as the template, with the licensing word
    at the same place, where it can reach the threshold. A cosine is at most the root of the share of the template's squared
    weight that lies on words of the window, so what is left out here could not score THRESHOLD against that template."""
    w = F.split("context", " ")
    weight: dict[int, dict[str, float]] = {}
    for i, _, term, x in template_terms()[0]:
        weight.setdefault(i, {})[term] = x * x
    cut = []
    for i, (_, text) in enumerate(TEMPLATES):
        own, n = F.create_map(*[F.lit(v) for kv in weight[i].items() for v in kv]), len(_words(text))
        terms = F.array(*[F.lit(t) for t in weight[i]])
        for j in (j for j, x in enumerate(_words(text)) if re.search(LICENSING, x)):
            box = F.slice(w, F.greatest(F.col("hit") - j, F.lit(0)) + 1, F.least(F.lit(n), F.col("hit") - j + n))
            share = F.aggregate(F.array_intersect(box, terms), F.lit(0.0), adding(own))
            cut.append(F.when(share >= THRESHOLD * THRESHOLD - 1e-6, F.array_join(box, " ")))
    return F.filter(F.array_distinct(F.array(*cut)), lambda x: x.isNotNull() & x.rlike("|".join(NAMED.values())))


def template_terms() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template number, licence, term, unit weight) rows, idf by term, and idf of any other term."""
    bags = [Counter(re.findall(WORD, t.lower())) for _, t in TEMPLATES]
    n = len(bags)
    df = Counter(w for b in bags for w in b)
    idf = {w: log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    rows = []
    for i, b in enumerate(bags):
        weight = {w: (1 + log(c)) * idf[w] for w, c in b.items()}
        size = sum(x * x for x in weight.values()) ** 0.5
        rows += [(i, TEMPLATES[i][0], w, x / size) for w, x in sorted(weight.items())]
    return rows, idf, log(1 + n) + 1


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(df: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, path, license, score, origin ('file', 'header', 'inherited' or 'none'), from_dir and
    n_units (licensing units of the file) for every row.

    Null paths are the empty path, in the root directory ''; null texts are empty. A tie between
    templates goes to the first identifier; between licence files of a directory, to the first path.
    Rows that repeat a path are scored alone and share their directory's licence.
    """
    spark = df.sparkSession
    rows, idf, other = template_terms()
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, w double"))  # a fixed, small table
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    is_file = path.rlike(LICENSE_FILE)
    lines = F.when(text.rlike(HEADER), F.filter(F.split(text, "\n"), lambda x: x.rlike(HEADER))).otherwise(F.array().cast("array<string>"))
    units = F.when(is_file & (text != ""), F.array_union(F.array_distinct(lines), F.array(text))).otherwise(F.array_distinct(lines))
    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), is_file.alias("is_file"), units.alias("units"), F.when(text.rlike(HEADER), text).alias("text"))
    src = saved(src, "licence-units")
    files = src.select("row", "doc_id", "path", "is_file", F.size("units").alias("n_units"), parent(F.col("path")).alias("dir"))
    spread = src.where(F.size("units") > 0).select("row", F.explode("units").alias("unit")).withColumn("uid", F.md5("unit"))
    around = window_contexts(src.where("text is not null").select("row", "text")).withColumn("cid", F.md5(F.concat_ws("|", "context", "hit")))
    around = saved(around, "licence-contexts")
    pieces = around.groupBy("cid").agg(F.min("context").alias("context"), F.min("hit").alias("hit")).select("cid", "context", F.explode(windows()).alias("unit")).withColumn("uid", F.md5("unit"))
    pieces = saved(pieces, "licence-windows")
    distinct = spread.select("uid", "unit").union(pieces.select("uid", "unit")).groupBy("uid").agg(F.min("unit").alias("unit"))
    tf = (
        distinct.select("uid", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(WORD), F.lit(0))).alias("term"))
        .groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(idfs, "term", "left")
        .select("uid", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).alias("x"))
    )
    tf = saved(tf, "licence-terms")
    norm = tf.groupBy("uid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = tf.join(vectors, "term").groupBy("uid", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scores = (
        dot.join(norm, "uid").select("uid", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
        .where(F.col("score") >= THRESHOLD).groupBy("uid", "license").agg(F.max("score").alias("score"))
    )
    scores = saved(scores, "licence-scores")
    best = lambda words: F.min(F.struct((-F.col("score")).alias("s"), stated(F.col("license"), words).alias("license"))).alias("best")
    plain = F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", " ")
    lined = spread.select("uid", "unit").distinct().join(scores, "uid").groupBy("uid").agg(best(plain))
    boxed = pieces.join(scores, "uid").where(named(F.col("license"), F.col("unit"))).groupBy("cid").agg(best(F.col("context")))
    own = spread.select("row", "uid").join(lined, "uid").select("row", "best").union(around.select("row", "cid").join(boxed, "cid").select("row", "best"))
    own = own.groupBy("row").agg(F.min("best").alias("best"))
    filed = saved(files.join(own, "row", "left").select("row", "doc_id", "path", "dir", "is_file", "n_units", F.col("best.license").alias("own"), (-F.col("best.s")).alias("own_score")), "licence-files")
    dirs = (
        filed.where("is_file and own is not null").groupBy("dir")
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own").alias("license"))).alias("d"))
        .select(F.col("dir").alias("up"), "d.license", (-F.col("d.s")).alias("score"))
    )
    # Every directory that holds files looks up its ancestors, itself first; the deepest with a licence stays.
    steps = F.split(F.col("dir"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    above = filed.select("dir").distinct().select("dir", F.explode(F.array_union(F.array(F.lit("")), ancestors)).alias("up"))
    nearest = saved(
        above.join(dirs, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "license", "score")).alias("d"))
        .select("dir", F.col("d.up").alias("from_dir"), F.col("d.license").alias("given"), F.col("d.score").alias("given_score")), "licence-dirs")
    both = filed.join(nearest, "dir", "left")
    kept = F.col("own").isNotNull()
    return both.select(
        "doc_id", "path", F.coalesce("own", "given").alias("license"), F.when(kept, F.col("own_score")).otherwise(F.col("given_score")).alias("score"),
        F.when(kept & F.col("is_file"), "file").when(kept, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~kept, F.col("from_dir")).alias("from_dir"), "n_units")


def document_path() -> Column:
    """Paths for the registered query: source/lang/id.txt, and a licence file for every 50th id,
    every second of those in the source's own directory."""
    source, lang, i = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")
    return (F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", source, F.concat(F.lit("LICENSE."), i)))
            .when(F.col("doc_id") % 50 == 0, F.concat_ws("/", source, lang, F.concat(F.lit("LICENSE."), i)))
            .otherwise(F.concat_ws("/", source, lang, F.concat(i, F.lit(".txt")))))


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows, idf, other = template_terms()
    given = ", ".join(f"({i}, {quoted(x)}, {quoted(t)}, {w!r}::double)" for i, x, t, w in rows)
    idfs = ", ".join(f"({quoted(t)}, {x!r}::double)" for t, x in sorted(idf.items()))
    return f"""
with v(template, license, term, w) as (values {given}), g(term, idf) as (values {idfs}),
f as (select doc_id, coalesce(text, '') as text, case when doc_id % 100 = 0 then coalesce(source, '') || '/LICENSE.' || doc_id
        when doc_id % 50 = 0 then coalesce(source, '') || '/' || coalesce(lang, '') || '/LICENSE.' || doc_id
        else coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' end as path from documents),
h as (select *, regexp_matches(path, '{LICENSE_FILE}') as is_file, regexp_replace(path, '/[^/]*$', '') as dir,
        list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HEADER}'))) as lines from f),
u0 as (select *, case when is_file and text <> '' then list_distinct(list_append(lines, text)) else lines end as units from h),
s as (select doc_id, unnest(units) as unit from u0),
t as (select unit, term, count(*) as tf from (select unit, unnest(regexp_extract_all(lower(unit), '{WORD}')) as term from (select distinct unit from s)) group by all),
x as (select unit, t.term, (1 + ln(tf)) * coalesce(idf, {other!r}::double) as x from t left join g using (term)),
n as (select unit, sqrt(sum(x * x)) as norm from x group by 1),
d as (select unit, template, license, sum(x * w) as dot from x join v using (term) group by all),
c as (select unit, license, round(dot / norm, 6) as score from d join n using (unit) where round(dot / norm, 6) >= {THRESHOLD}),
o as (select doc_id, license, score from s join c using (unit) qualify row_number() over (partition by doc_id order by score desc, license) = 1),
e as (select u0.*, o.license as own, o.score as own_score from u0 left join o using (doc_id)),
r as (select dir as up, own as license, own_score as score from e where is_file and own is not null qualify row_number() over (partition by dir order by own_score desc, path) = 1),
a as (select distinct dir, unnest(list_distinct(list_concat([''], list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))))) as up from e),
b as (select dir, up as from_dir, license as given, score as given_score from a join r using (up) qualify row_number() over (partition by dir order by length(up) desc) = 1)
select doc_id, path, coalesce(own, given) as license, case when own is not null then own_score else given_score end as score,
  case when own is not null and is_file then 'file' when own is not null then 'header' when given is not null then 'inherited' else 'none' end as origin,
  case when own is null then from_dir end as from_dir, len(units)::int as n_units
from e left join b using (dir)
"""
