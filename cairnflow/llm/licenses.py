"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. A notice may stand anywhere in a text, wrapped over lines or within a long one: wherever a whole text has a
template's anchor (its first word among ``ANCHORS``), the tokens around it that lie where the template's would are a candidate, as long as
the template. A candidate's vector holds its tokens' counts times the inverse document frequency among the templates (a
token that no template has weighs most), and its cosine with the template is a sparse product: tokens of the distinct candidates
meet template weights in a join with the constant template table. The best template at ``LEAST`` or more is the file's own license.

A file that has none inherits: files named like a licence file speak for their directory, and directories (not
files) are joined with their ancestors, the deepest one that has a license wins.

Defined results: null and empty texts have no candidate; a candidate ends where its text does; ties go to the earlier place, then the
template first by name, and for a directory to the better score, then the smaller path; equal rows give equal results; other columns pass
unread unless they have a result's name; a file in no directory with a license has origin ``none``; a null path inherits nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Licence names and the wording of their usual notices.
TEMPLATES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: A text without one of these has no notice.
TRIGGER = r"(?i)licen[cs]e|rights reserved|public domain|unencumbered|spdx|permission is hereby|permission to use|redistribution and use"
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
#: Words at which candidates are laid, in this order of preference; spelled as in TEMPLATES.
ANCHORS = ("spdx", "licensed", "license", "redistribution", "permission", "rights", "unencumbered", "dedicated")
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|copyright|notice)[^/]*$"
LEAST = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER)).replace("licence", "license"))


def template_weights() -> tuple[list[tuple[int, str, str, float, float]], float]:
    """(template, license, token, weight, idf) rows with weights over the template's length, and the idf of a token in no template."""
    bags = [Counter(tokens_of(text)) for _, text in TEMPLATES]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(TEMPLATES, bags)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, name, t, n * idf[t] / norm, idf[t]) for t, n in sorted(bag.items())]
    return rows, math.log(1 + len(bags)) + 1


def template_anchors() -> list[tuple[str, int, str, int, int]]:
    """(anchor, template, license, tokens before it, tokens in all) of each template."""
    out = []
    for i, (name, text) in enumerate(TEMPLATES):
        said = tokens_of(text)
        word = next(w for w in ANCHORS if w in said)
        out.append((word, i, name, said.index(word), len(said)))
    return out


def notices(files: DataFrame) -> DataFrame:
    """file, own_license, own_score, own_at (the first token of the notice, from 0) for each file that has a license of its own.

    ``files`` has (file, text), where equal values of file have equal texts.
    """
    spark = files.sparkSession
    rows, unknown = template_weights()
    weights = F.broadcast(spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "template int, token string, weight double"))
    idf = F.broadcast(spark.createDataFrame(sorted({(r[2], r[4]) for r in rows}), "token string, idf double"))
    anchors = F.broadcast(spark.createDataFrame(template_anchors(), "anchor string, template int, license string, before int, length int"))
    reach = max(len(tokens_of(text)) for _, text in TEMPLATES)

    def spots(ts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: F.get(ts, i).isin(*ANCHORS))
        around = lambda i: F.slice(ts, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach)
        return F.when(F.size(ts) > 0, F.transform(at, lambda i: F.struct(i.alias("at"), F.get(ts, i).alias("anchor"), F.least(i, F.lit(reach)).alias("place"), around(i).alias("around"))))

    said = F.regexp_extract_all(F.replace(F.translate("text", UPPER, LOWER), F.lit("licence"), F.lit("license")), F.lit(TOKEN), 0)
    found = files.where(F.col("text").rlike(TRIGGER)).select("file", F.inline(F.get(F.transform(F.array(said), spots), F.lit(0)))).join(anchors, "anchor")
    missing = F.greatest(F.col("before") - F.col("place"), F.lit(0))
    window = F.array_join(F.slice("around", F.greatest(F.col("place") - F.col("before"), F.lit(0)) + 1, F.col("length") - missing), " ")
    found = found.select("file", (F.col("at") - F.col("before") + missing).alias("at"), "template", "license", window.alias("said"))
    token = found.select("template", "said").distinct().select("template", "said", F.explode(F.split("said", " ")).alias("token"))
    counted = token.groupBy("template", "said", "token").agg(F.count(F.lit(1)).alias("tf")).join(idf, "token", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    product = counted.join(weights, ["template", "token"], "left").groupBy("template", "said").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    scored = product.withColumn("score", F.round(F.col("dot") / F.col("norm"), 4)).where(F.col("score") >= LEAST).select("template", "said", "score")
    best = F.max_by(F.struct("license", "score", "at"), F.struct(F.col("score"), -F.col("at"), -F.col("template")))
    own = found.join(scored, ["template", "said"]).groupBy("file").agg(best.alias("b"))
    return own.select("file", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"), F.col("b.at").alias("own_at"))


def directory(path: Column) -> Column:
    """The path without its last part; empty for a path without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """path, own_license, own_score, own_at, license, origin (own, inherited, none), license_dir for each row of (path, text), and its further columns, whatever
    their names; one that is named as a result is left out."""
    results = ("own_license", "own_score", "own_at", "license", "origin", "license_dir")
    more = [c for c in files.columns if c.lower() not in ("path", "text", *results)]
    named = {c: f"further_{i}_" for i, c in enumerate(more)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    files = files.select("path", "text", *[quoted(c).alias(n) for c, n in named.items()])
    keyed = files.withColumn("file", F.md5(F.coalesce("text", F.lit("")))).withColumn("dir", directory(F.col("path")))
    own = notices(keyed.select("file", "text").where(F.col("text").rlike(TRIGGER)).dropDuplicates(["file"]))
    plain = keyed.drop("text").join(own, "file", "left").drop("file")
    speaking = plain.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    by_dir = speaking.groupBy(F.col("dir").alias("license_dir")).agg(F.min_by(F.col("own_license"), F.struct(-F.col("own_score"), F.col("path"))).alias("dir_license"))
    # each directory's ancestors, itself included; the deepest that has a license
    parts = F.split("dir", "/")
    dirs = plain.where("own_license is null and dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    nearest = above.join(by_dir, F.col("up") == F.col("license_dir")).groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license"), "depth").alias("n"))
    nearest = nearest.select(F.col("dir").alias("n_dir"), F.col("n.license_dir").alias("license_dir"), F.col("n.dir_license").alias("dir_license"))
    out = plain.join(nearest, F.col("own_license").isNull() & (F.col("dir") == F.col("n_dir")), "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    out = out.withColumn("license", F.coalesce("own_license", "dir_license")).withColumn("origin", origin)
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], "path", *results)


#: The layout that the query gives the documents: source / shelf of 16384 ids / box of 1024 ids / file; every eighth file is named as a licence file.
SHELF, BOX, NAMED = 16384, 1024, 8


def document_files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) of the documents in that layout."""
    name = F.when(F.col("doc_id") % NAMED == 0, F.lit("LICENSE-")).otherwise(F.lit("doc-"))
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("unknown")), F.concat(F.lit("shelf"), F.floor(F.col("doc_id") / SHELF)), F.concat(F.lit("box"), F.floor(F.col("doc_id") / BOX)), F.concat(name, F.col("doc_id"), F.lit(".txt")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text"))


def scan_sql() -> str:
    """The query over documents as DuckDB SQL."""
    rows, unknown = template_weights()
    values = ", ".join(f"({i}, '{t}', {w!r}::DOUBLE, {d!r}::DOUBLE)" for i, _, t, w, d in rows)
    anchors = ", ".join(f"('{w}', {i}, '{name}', {before}, {n})" for w, i, name, before, n in template_anchors())
    trigger, licence = TRIGGER, LICENCE_FILE
    return f"""
WITH weights(template, token, weight, idf) AS (VALUES {values}),
idfs AS (SELECT DISTINCT token, idf FROM weights),
anchors(anchor, template, license, before, length) AS (VALUES {anchors}),
files AS (
  SELECT doc_id, text, md5(COALESCE(text, '')) AS file,
    concat_ws('/', COALESCE(source, 'unknown'), 'shelf' || CAST(floor(doc_id / {SHELF}.0) AS BIGINT), 'box' || CAST(floor(doc_id / {BOX}.0) AS BIGINT),
      CASE WHEN doc_id % {NAMED} = 0 THEN 'LICENSE-' ELSE 'doc-' END || doc_id || '.txt') AS path
  FROM documents
), cut AS (
  SELECT file, regexp_extract_all(replace(translate(text, '{UPPER}', '{LOWER}'), 'licence', 'license'), '{TOKEN}') AS ts
  FROM (SELECT DISTINCT file, text FROM files WHERE regexp_matches(text, '{trigger}'))
), spots AS (
  SELECT file, ts, unnest(list_filter(range(1, len(ts) + 1), lambda i: ts[i] IN {ANCHORS})) AS i FROM cut
), found AS (
  SELECT file, greatest(i - before, 1) - 1 AS spot, a.template, a.license, array_to_string(ts[greatest(i - before, 1) : i - before + length - 1], ' ') AS said FROM spots JOIN anchors a ON ts[i] = a.anchor
), counted AS (
  SELECT template, said, t.token, count(*) * COALESCE(any_value(idf), {unknown!r}::DOUBLE) AS x
  FROM (SELECT template, said, unnest(string_split(said, ' ')) AS token FROM (SELECT DISTINCT template, said FROM found)) t LEFT JOIN idfs USING (token) GROUP BY ALL
), scores AS (
  SELECT template, said, round(sum(x * weight) / sqrt(sum(x * x)), 4) AS score FROM counted LEFT JOIN weights USING (template, token) GROUP BY template, said
), scored AS (
  SELECT file, spot, template, license, score FROM found JOIN scores USING (template, said)
), own AS (
  SELECT * FROM scored WHERE score >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, spot, template) = 1
), plain AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license AS own_license, score AS own_score, CAST(spot AS INTEGER) AS own_at FROM files LEFT JOIN own USING (file)
), by_dir AS (
  SELECT dir AS license_dir, own_license AS dir_license FROM plain WHERE own_license IS NOT NULL AND regexp_matches(path, '{licence}')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1
), above AS (
  SELECT DISTINCT dir, array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS up, n FROM (SELECT DISTINCT dir FROM plain WHERE own_license IS NULL), unnest(range(1, 16)) AS t(n)
  WHERE n <= len(string_split(dir, '/'))
), nearest AS (
  SELECT dir, license_dir, dir_license FROM above JOIN by_dir ON up = license_dir QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC) = 1
)
SELECT p.doc_id, p.path, p.own_license, p.own_score, p.own_at, n.license_dir, COALESCE(p.own_license, n.dir_license) AS license,
  CASE WHEN p.own_license IS NOT NULL THEN 'own' WHEN n.dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM plain p LEFT JOIN nearest n ON p.own_license IS NULL AND p.dir = n.dir
"""


def scan_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(document_files(docs)).select("doc_id", "path", "own_license", "own_score", "own_at", "license_dir", "license", "origin")
