"""Licence scan: TF-IDF cosine of lines and licence files to templates, then inheritance by directory.

Terms are runs of ASCII letters and digits, lower-cased, but for common words. Inverse document frequencies come from the
templates; a term of none has the highest. A line can only reach the threshold if it has one of a few
anchor terms: without them the rest of a template's weight is too small. So lines are first filtered
by these, which loses nothing, and only the rest is taken apart.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .text import lines

# The usual notices of common licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
# Common words, which are no terms.
COMMON = tuple(
    "a all an and any are as at be by can for from have in is it may not of on or that the this to under use was with you".split()
)
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$"
THRESHOLD = 700  # per mille of the cosine


def terms(text: str) -> list[str]:
    return [t for t in map(str.lower, re.findall("[A-Za-z0-9]+", text)) if t not in COMMON]


def frequencies(notices: list[tuple[str, str]]) -> dict[str, float]:
    """Inverse document frequency of each term of the notices."""
    seen = Counter(t for _, text in notices for t in set(terms(text)))
    return {t: log((1 + len(notices)) / (1 + n)) + 1 for t, n in seen.items()}


def unseen_frequency(notices: list[tuple[str, str]]) -> float:
    return log(1 + len(notices)) + 1


def weights(notices: list[tuple[str, str]]) -> list[tuple[int, str, str, float]]:
    """(notice, licence, term, weight) with weights of unit length for each notice."""
    idf = frequencies(notices)
    out = []
    for i, (licence, text) in enumerate(notices):
        counts = Counter(terms(text))
        length = sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        out += [(i, licence, t, n * idf[t] / length) for t, n in sorted(counts.items())]
    return out


def anchors(notices: list[tuple[str, str]], threshold: int) -> list[str]:
    """Terms of which a text must have one to reach the threshold for any notice; words before single
    characters, and rare ones first."""
    found: set[str] = set()
    idf = frequencies(notices)
    for i in range(len(notices)):
        own = sorted((len(t) < 2, -idf[t], -w, t) for n, _, t, w in weights(notices) if n == i)
        rest = sum(w * w for _, _, w, _ in own)
        for _, _, w, t in own:
            if sqrt(max(0.0, rest)) * 1000 < threshold - 1:
                break
            found.add(t)
            rest -= w * w
    return sorted(found)


def _file(path: str, text: str) -> Column:
    """What stands for a file: its path and a hash of its text. Equal rows are one file."""
    return F.struct(F.col(path).alias("path"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))


def own_licences(files: DataFrame, path: str, text: str, notices: list[tuple[str, str]], threshold: int) -> DataFrame:
    """``file``, ``licence``, ``score`` of each file with a line, or for licence files a whole text, that
    reaches the threshold; the best by score, then name."""
    spark = files.sparkSession
    idf = F.broadcast(spark.createDataFrame(list(frequencies(notices).items()), "term string, idf double"))
    listed = F.broadcast(spark.createDataFrame(weights(notices), "notice int, licence string, term string, weight double"))
    pattern = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(anchors(notices, threshold))})(?![A-Za-z0-9])"
    near = files.select(_file(path, text).alias("file"), F.col(path).alias("path"), F.col(text).alias("text"))
    near = near.where(F.col("text").rlike(pattern))
    whole = F.when(F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = near.select("file", F.posexplode(F.concat(whole, F.filter(lines(F.col("text")), lambda x: x.rlike(pattern)))).alias("place", "unit"))
    counted = cut_lineage(
        units.select("file", "place", F.explode(F.regexp_extract_all("unit", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("term"))
        .withColumn("term", F.lower("term")).where(~F.col("term").isin(*COMMON))
        .groupBy("file", "place", "term").agg(F.count("*").alias("n"))
        .join(idf, "term", "left")
        .withColumn("value", F.col("n") * F.coalesce("idf", F.lit(unseen_frequency(notices))))
    )
    length = counted.groupBy("file", "place").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    shared = counted.join(listed, "term").groupBy("file", "place", "licence", "notice").agg(
        F.sum(F.col("value") * F.col("weight")).alias("product")
    )
    score = F.floor(1000 * F.col("product") / F.col("length") + 0.5).cast("int")
    scored = shared.join(length, ["file", "place"]).select("file", "licence", score.alias("score"))
    scored = scored.where(F.col("score") >= threshold).groupBy("file", "licence").agg(F.max("score").alias("score"))
    # The best score, then the first name.
    best = F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence"))
    return scored.groupBy("file").agg(best.alias("b")).select("file", "b.licence", "b.score")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """``folder``, ``licence``, ``score``, ``origin`` of the nearest of a folder and its ancestors that has a licence.

    ``folders`` are distinct, so the joins grow with them and not with the files in them.
    """
    parts = F.split("folder", "/")
    up = folders.select("folder", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("origin"))
    )).alias("a")).select("folder", "a.*").distinct()
    near = up.join(licensed, "origin")
    nearest = F.max_by(F.struct("licence", "score", "origin"), "depth").alias("b")
    return near.groupBy("folder").agg(nearest).select("folder", "b.*")


def scan(
    files: DataFrame, path: str = "path", text: str = "text",
    notices: list[tuple[str, str]] | None = None, threshold: int = THRESHOLD,
) -> DataFrame:
    """``files`` with ``licence``, ``licence_score`` (cosine in per mille) and ``licence_from``.

    ``licence_from`` is the file's own path if its text names a licence, else the folder it inherits
    from: the nearest one on its path with a licence file (by name) that does. A folder's licence is
    the best of its licence files by score, then name. Null where there is none. A null or empty text
    names none; a null path has no folder. Rows equal in path and text are treated alike. Columns of
    these three names are replaced.
    """
    notices = NOTICES if notices is None else notices
    names = [f"c{i}" for i in range(len(files.columns))]
    at = dict(zip(files.columns, names))
    rows = files.toDF(*names)
    own = cut_lineage(own_licences(rows, at[path], at[text], notices, threshold))
    own = own.select(F.col("file.path").alias("_path"), F.col("file.hash").alias("_hash"), F.col("licence").alias("_own"), F.col("score").alias("_own_score"))
    licensed = (
        own.where(F.col("_path").rlike(LICENCE_FILE)).groupBy(_folder(F.col("_path")).alias("origin"))
        .agg(F.min_by(F.struct(F.col("_own").alias("licence"), F.col("_own_score").alias("score")), F.struct(-F.col("_own_score"), "_own")).alias("b"))
        .select("origin", "b.*")
    )
    rows = rows.withColumn("_file", _file(at[path], at[text])).withColumn("_folder", _folder(F.col(at[path])))
    folders = rows.where(F.col("_folder").isNotNull()).select(F.col("_folder").alias("folder")).distinct()
    above = inherited(folders, licensed)
    joined = rows.join(own, F.col("_file.path").eqNullSafe(F.col("_path")) & (F.col("_file.hash") == F.col("_hash")), "left")
    joined = joined.join(above, F.col("_folder") == F.col("folder"), "left")
    has = F.col("_own").isNotNull()
    kept = [c for c in files.columns if c not in ("licence", "licence_score", "licence_from")]
    return joined.select(
        *[F.col(at[c]).alias(c) for c in kept],
        F.coalesce("_own", "licence").alias("licence"),
        F.when(has, F.col("_own_score")).otherwise(F.col("score")).alias("licence_score"),
        F.when(has, F.col(at[path])).otherwise(F.col("origin")).alias("licence_from"),
    )


def sql(files_sql: str, notices: list[tuple[str, str]] | None = None, threshold: int = THRESHOLD) -> str:
    """The scan of ``files_sql`` (doc_id, path, text; unique, without nulls) in DuckDB's SQL, over all lines; score 0 for none."""
    notices = NOTICES if notices is None else notices
    idf = ", ".join(f"('{t}', {v!r}e0)" for t, v in sorted(frequencies(notices).items()))
    listed = ", ".join(f"({i}, '{licence}', '{t}', {w!r}e0)" for i, licence, t, w in weights(notices))
    name = LICENCE_FILE
    return rf"""
WITH files AS ({files_sql}),
idf(term, idf) AS (VALUES {idf}),
listed(notice, licence, term, weight) AS (VALUES {listed}),
units AS (
    SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS place FROM (
        SELECT doc_id, string_split(text, chr(10)) || CASE WHEN regexp_matches(path, '{name}') THEN [text] ELSE [] END AS u FROM files
    )
), counted AS (
    SELECT doc_id, place, term, n, n * coalesce(idf, {unseen_frequency(notices)!r}e0) AS value FROM (
        SELECT doc_id, place, lower(term) AS term, count(*) AS n
        FROM (SELECT doc_id, place, unnest(regexp_extract_all(unit, '[A-Za-z0-9]+')) AS term FROM units)
        WHERE lower(term) NOT IN ({', '.join(repr(w) for w in COMMON)}) GROUP BY doc_id, place, lower(term)
    ) LEFT JOIN idf USING (term)
), lengths AS (SELECT doc_id, place, sqrt(sum(value * value)) AS length FROM counted GROUP BY ALL
), shared AS (
    SELECT doc_id, place, licence, notice, sum(value * weight) AS product FROM counted JOIN listed USING (term) GROUP BY ALL
), scored AS (
    SELECT doc_id, licence, CAST(floor(1000 * product / length + 0.5) AS INTEGER) AS score
    FROM shared JOIN lengths USING (doc_id, place)
), own AS (
    SELECT * FROM scored WHERE score >= {threshold}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1
), placed AS (
    SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder, licence, score
    FROM files f LEFT JOIN own USING (doc_id)
), licensed AS (
    SELECT folder AS origin, licence, score FROM placed
    WHERE licence IS NOT NULL AND regexp_matches(path, '{name}')
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, licence) = 1
), near AS (
    SELECT p.doc_id, l.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY length(l.origin) DESC) AS nth
    FROM placed p JOIN licensed l ON p.folder = l.origin OR l.origin = '' OR starts_with(p.folder, l.origin || '/')
)
SELECT p.doc_id, coalesce(p.licence, n.licence) AS licence,
       coalesce(CASE WHEN p.licence IS NULL THEN n.score ELSE p.score END, 0) AS licence_score,
       CASE WHEN p.licence IS NULL THEN n.origin ELSE p.path END AS licence_from
FROM placed p LEFT JOIN near n ON p.doc_id = n.doc_id AND n.nth = 1
"""
