"""License notices in documents, with DataFrame functions only.

Texts become words (runs of letters and digits, in lower case) and overlapping five-word shingles, hashed to 64 bits.
Retrieval: a document is cut into overlapping windows for each template of n shingles, 2n shingles long, a new one at
every half template, so any stretch of 1.25n shingles lies whole in some window. A template is retrieved by a window
that shares one of BANDS bands of one MinHash row each. A stretch that holds 0.8 of the template has a Jaccard
similarity of at least 0.8 / 2.2 with its template, and so shares a band with a probability of 1 - (1 - 0.36)^32 or more,
that is all but one in 10^6. A window can share a band only if it holds the template's smallest shingle of that band,
so only windows around these anchors are ever built; nothing that could match is skipped by that.
Verification: for each retrieved document and template, the stretch of 1.25n shingles with the most of the template's
shingles is found among all its places; a match holds `least` (0.8) of them or more.

Everything happens inside a document's row: no shuffle, no join, and no group that could be hot. The templates (a
bounded list, a parameter) are literals.

Defined cases: null and empty texts and texts below five words match nothing and give no row. Each repeated row gives its
own rows. A document that holds several notices gives a row for each template. Templates need five words or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS, LEAST = 5, 32, 0.8

# Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_SEPARATORS = "[^\\p{L}\\p{N}]+"


def _shingles(text: Column) -> Column:
    """Hashes of the text's shingles in order; an empty array below WIDTH words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(hashes: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(hashes) - WIDTH)
    return F.when(F.size(hashes) >= WIDTH, F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))).otherwise(F.array().cast("array<bigint>"))


def _row(shingle: Column, band: Column | int) -> Column:
    """A MinHash row: another hash of the shingle for each band."""
    return F.xxhash64(shingle, band if isinstance(band, Column) else F.lit(band))


def prepared(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Name, distinct shingles, and for each band the smallest row with its shingle (the anchor) of every template."""
    frame = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    frame = frame.select("name", _shingles(F.col("text")).alias("w")).select("name", F.array_distinct(_joined(F.col("w"))).alias("s"))
    smallest = lambda b: F.array_min(F.transform("s", lambda x: F.struct(_row(x, b).alias("row"), x.alias("anchor"))))
    bands = F.array(*[smallest(b) for b in range(BANDS)])
    rows = frame.select("name", "s", bands.alias("bands")).collect()  # one row for each template
    short = [r["name"] for r in rows if not r["s"]]
    if short:
        raise ValueError(f"templates below {WIDTH} words: {short}")
    return [{"name": r["name"], "s": r["s"], "bands": [(b, m["row"], m["anchor"]) for b, m in enumerate(r["bands"])]} for r in rows]


def _literal(templates: list[dict]) -> Column:
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    return F.array(*[
        F.struct(
            F.lit(t["name"]).alias("name"), longs(t["s"]).alias("s"), longs(sorted({a for _, _, a in t["bands"]})).alias("anchors"),
            F.array(*[F.struct(F.lit(b).alias("b"), F.lit(m).cast("long").alias("row")) for b, m, _ in t["bands"]]).alias("bands"),
            F.lit(2 * len(t["s"])).alias("window"), F.lit(max(1, len(t["s"]) // 2)).alias("stride"), F.lit(-(-5 * len(t["s"]) // 4)).alias("stretch"),
        )
        for t in templates
    ])


def _retrieved(s: Column, t: Column) -> Column:
    """Whether some window around an anchor shares a band with the template."""
    places = F.filter(F.transform(s, lambda x, i: F.when(F.array_contains(t["anchors"], x), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.transform(F.sequence(F.lit(0), F.floor(t["window"] / t["stride"]).cast("int")), lambda k: F.greatest((F.floor(p / t["stride"]) - k) * t["stride"], F.lit(0)).cast("int")))))
    shared = lambda window: F.exists(t["bands"], lambda b: F.array_min(F.transform(window, lambda x: _row(x, b["b"]))) == b["row"])
    return F.exists(starts, lambda at: shared(F.slice(s, at + 1, t["window"])))


def _best(t: Column, hits: Column) -> Column:
    """Most distinct shingles of the template in a stretch, and the first place where a stretch holds them; hits are in order."""
    held = lambda h, i: F.size(F.array_distinct(F.transform(F.filter(F.slice(hits, i + 1, t["stretch"]), lambda g: g["at"] < h["at"] + t["stretch"]), lambda g: g["x"])))
    return F.array_max(F.transform(hits, lambda h, i: F.struct(held(h, i).alias("n"), (-h["at"]).alias("at"))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, matched (distinct shingles), containment and first_word of each notice in each document."""
    known = _literal(prepared(docs.sparkSession, templates))
    # explode keeps the optimiser from computing the shingles twice, once for a pushed filter
    found = docs.select("doc_id", _shingles(F.col("text")).alias("w")).select("doc_id", _joined(F.col("w")).alias("s"))
    found = found.select("doc_id", "s", F.explode(F.filter(known, lambda t: F.arrays_overlap("s", t["anchors"]))).alias("t"))
    s, t = F.col("s"), F.col("t")
    found = found.where(_retrieved(s, t))
    hits = F.filter(F.transform(s, lambda x, i: F.when(F.array_contains(t["s"], x), F.struct(i.alias("at"), x.alias("x")))), lambda h: h.isNotNull())
    found = found.select("doc_id", "t", hits.alias("hits")).select("doc_id", "t", F.explode(F.array(_best(t, F.col("hits")))).alias("best"))
    share = F.col("best.n") / F.size("t.s")
    return found.where(share >= least).select("doc_id", F.col("t.name").alias("license"), F.col("best.n").cast("int").alias("matched"), share.alias("containment"), (-F.col("best.at")).cast("int").alias("first_word"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same in SQL, by comparing every shingle of every document with every template."""
    values = ", ".join("('{}', '{}')".format(n, x.replace("'", "''")) for n, x in sorted(templates.items()))
    return f"""
WITH given(license, text) AS (VALUES {values}),
words AS (
  SELECT d AS row_no, doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)
), shingles AS (
  SELECT row_no, doc_id, pos, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS s, lead(word, 4) OVER o AS last
  FROM words WINDOW o AS (PARTITION BY row_no ORDER BY pos)
), own AS (
  SELECT license, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM given)
), template AS (
  SELECT DISTINCT license, s FROM (
    SELECT license, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS s, lead(word, 4) OVER o AS last
    FROM own WINDOW o AS (PARTITION BY license ORDER BY pos)) WHERE last IS NOT NULL
), sized AS (SELECT license, count(*) AS n FROM template GROUP BY license),
hits AS (SELECT row_no, doc_id, pos, t.license, t.s, n FROM shingles h JOIN template t ON h.s = t.s JOIN sized z ON z.license = t.license WHERE h.last IS NOT NULL),
stretches AS (
  SELECT a.row_no, a.doc_id, a.license, a.n, a.pos, count(DISTINCT b.s) AS matched
  FROM hits a JOIN hits b ON a.row_no = b.row_no AND a.license = b.license AND b.pos >= a.pos AND b.pos < a.pos + ceil(a.n * 1.25)
  GROUP BY ALL
)
SELECT doc_id, license, max(matched)::INT AS matched, max(matched) / max(n)::DOUBLE AS containment, arg_max(pos, matched * 10000000000 - pos)::INT AS first_word
FROM stretches GROUP BY row_no, doc_id, license HAVING max(matched) >= {least}::DOUBLE * max(n)
"""
