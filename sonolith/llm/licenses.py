"""License scans, in DataFrame functions only.

A template is a license notice. Its windows of 1 or 8 word shingles stand in an index under their MinHash
bands. A text is read in overlapping windows of each size; equal bands retrieve templates. Text windows
step by half a window and template windows by one shingle. A template uses the larger size only if it is
long enough to hold one of a text's windows whole wherever they start: so an unedited copy is found for
certain, and a window that keeps a similarity of 0.6 with probability 1 - 0.4 ** BANDS = 0.97. Exact containment of the template's
shingles in the text then verifies. All of it is one narrow pass; the index is a constant of the plan, of bounded
size: a larger bank of templates is cut into several constants with a pass each.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

SHINGLE, SIZES, BANDS, LEAST = 5, (1, 8), 4, 0.75
#: Templates and words of one constant of the plan; more of them make more constants.
MOST_TEMPLATES, MOST_WORDS = 500, 100_000
_SEEDS = (0, 0x1F3D5B79A2C4E685, 0x2E4C6A8091B3D5F7, 0x3B5D7F9182A4C6E8)

#: Names and texts of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(found: Column) -> Column:
    """Hashes of the five-word shingles in order; none for fewer than five words."""


    def hashed(ws: Column) -> Column:
        starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (SHINGLE - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, SHINGLE)]))

    return let(found, hashed)


def _least(window: Column, seed: int) -> Column:
    """MinHash value: the least of the hashes hashed with the seed, so each seed has an order of its own."""
    return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed))))


def _bands(hashes: Column, size: int, step: int) -> Column:
    """Keys of all windows of ``size`` shingles; a window's MinHash under each seed is its band."""
    if size == 1:
        return hashes

    def cut(hs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hs), F.lit(1)), F.lit(step))
        return F.filter(F.transform(starts, lambda i: F.slice(hs, i, F.lit(size))), lambda w: F.size(w) > 0)

    windows = let(hashes, cut)

    def keys(window: Column) -> Column:
        least = [_least(window, seed) for seed in _SEEDS[:BANDS]]
        return F.array(*[F.xxhash64(x, F.lit(size * BANDS + k)) for k, x in enumerate(least)])

    return F.flatten(F.transform(windows, keys))


_BANK = "array<struct<name:string,size:int,keys:array<bigint>,shingles:array<bigint>>>"


def _parts(templates: dict[str, str], most: int, most_words: int) -> list[dict[str, str]]:
    """``templates`` in parts of at most ``most`` templates and ``most_words`` words (or one template)."""
    parts: list[dict[str, str]] = [{}]
    held = 0
    for name, text in sorted(templates.items()):
        n = len(text.split())
        if parts[-1] and (len(parts[-1]) >= most or held + n > most_words):
            parts.append({})
            held = 0
        parts[-1][name] = text
        held += n
    return parts


def _bank(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """The index, computed by the expressions that read the texts."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.withColumn("shingles", F.array_distinct(shingles(words(F.col("text"))))).withColumn("ordered", shingles(words(F.col("text"))))
    fits = {s: F.size("ordered") >= s + max(1, s // 2) - 1 for s in sorted(SIZES, reverse=True)}
    fitting = [F.when(ok, _bands(F.col("ordered"), s, 1)) for s, ok in fits.items()]
    size = F.coalesce(*[F.when(ok, F.lit(s)) for s, ok in fits.items()])
    rows = rows.withColumn("keys", F.array_distinct(F.coalesce(*fitting))).withColumn("size", size).where("size(ordered) > 0")
    return [r.asDict() for r in rows.select("name", "size", "keys", "shingles").collect()]


def find_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST,
    most_templates: int = MOST_TEMPLATES, most_words: int = MOST_WORDS,
) -> DataFrame:
    """(doc_id, license, containment, n_shared): a row for each row of ``docs`` and template found in it.

    ``containment`` is the share of the template's distinct shingles that the whole text has, ``least`` or
    more. Null, empty and short texts have none; very long texts are read whole; repeated rows and null ids
    are treated like others; a template shorter than five words is ignored. Other columns are ignored; an
    empty table or bank gives an empty result. Any number of templates is searched, ``most_templates`` or
    ``most_words`` words of them in a pass.
    """
    parts = _parts(TEMPLATES if templates is None else templates, most_templates, most_words)
    found = [_scanned(docs, id_col, text_col, _bank(docs.sparkSession, part), least) for part in parts]
    return reduce(DataFrame.unionByName, found)


def _scanned(docs: DataFrame, id_col: str, text_col: str, bank: list[dict], least: float) -> DataFrame:
    known = F.from_json(F.lit(json.dumps(bank)), _BANK)
    used = sorted({b["size"] for b in bank})
    keys = F.from_json(F.lit(json.dumps(sorted({k for b in bank for k in b["keys"]}))), "array<bigint>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(f"`{text_col}`").cast("string")).alias("words"))
    rows = rows.select("doc_id", shingles(F.col("words")).alias("hashes"))
    bands = [_bands(F.col("hashes"), s, max(1, s // 2)) for s in used] or [F.array().cast("array<bigint>")]
    rows = rows.withColumn("hits", F.array_intersect(F.concat(*bands), keys)).where(F.size("hits") > 0)
    retrieved = F.filter(known, lambda t: F.arrays_overlap(t.keys, F.col("hits")))
    verified = F.transform(
        retrieved, lambda t: F.struct(t["name"].alias("name"), F.size(F.array_intersect(t.shingles, F.col("hashes"))).alias("n"), F.size(t.shingles).alias("of"))
    )
    verified = F.filter(verified, lambda t: t.n >= t.of * F.lit(least))
    return rows.select("doc_id", F.explode(verified).alias("t")).select(
        "doc_id", F.col("t.name").alias("license"), (F.col("t.n") / F.col("t.of")).alias("containment"), F.col("t.n").cast("long").alias("n_shared")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: DuckDB SQL for ``find_licenses`` over ``documents``: containment of every template in every text.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT true AS is_doc, doc_id::VARCHAR AS id, row_number() OVER () AS row_no, text FROM documents
  UNION ALL SELECT false, name, 0, text FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(TEMPLATES.items()))}) t(name, text)),
worded AS (
  SELECT is_doc, id, row_no, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM texts),
sets AS (
  SELECT is_doc, id, row_no, list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 1)),
         lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM worded),
spread AS (SELECT id AS name, len(s) AS n, unnest(s) AS x FROM sets WHERE NOT is_doc),
shared AS (
  SELECT d.id, d.row_no, t.name, t.n, count(*) AS k FROM (SELECT id, row_no, unnest(s) AS x FROM sets WHERE is_doc) d
  JOIN spread t ON t.x = d.x GROUP BY ALL)
SELECT id::BIGINT AS doc_id, name AS license, k::DOUBLE / n AS containment, k::BIGINT AS n_shared FROM shared WHERE k >= n * {LEAST}
"""
