"""License scans in DataFrame expressions: MinHash bands retrieve templates, exact containment decides.

Nothing here runs Python on the executors. A text becomes normalised words, words become hashed
two-word shingles, shingles are cut into blocks, and each two neighbouring blocks form a window, so
windows overlap by half. A window's least hash under each of ``BANDS`` seeds is a band of one row; a
window that agrees with a template in any band retrieves it. All of it stays in one row per document,
so the scan has no shuffle, whatever a document or a template holds.

Collision guarantee: a template is indexed by pieces of at most ``BLOCK + 1`` shingles, which lie in
one window wherever they start. A piece of k shingles inside a window of 2 * ``BLOCK`` meets it in one
band with chance k / (2 * BLOCK) at least, so in some band with 1 - (1 - k / 8) ** 16: 0.990 for two
shingles, 0.9995 for three, over 0.99998 from four on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.llm.rows import ROW, named, opened, with_row

SHINGLE = 2
BLOCK = 4
BANDS = 16
CONTAINMENT = 0.95

# Short notices that name a licence, as they stand in public texts.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-clause": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """A hash of each ``SHINGLE`` consecutive words; none if there are fewer words."""
    last = F.size(words) - SHINGLE
    one = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def _band_minima(shingles: Column) -> Column:
    """The least hash of the shingles under each seed."""
    seeds = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(seeds, lambda j: F.array_min(F.transform(shingles, lambda x: F.hash(x, j))))


def load_templates(spark, templates: dict[str, str]) -> tuple[dict[str, list[int]], dict[int, list[str]]]:
    """Distinct shingles of each template, and the templates that each band value retrieves.

    The catalogue is bounded: it is made of literals of the program and becomes part of the plan.
    """
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
    table = spark.createDataFrame(list(templates.items()), schema)
    listed = table.withColumn("words", words_of(F.col("text"))).withColumn("shingles", shingles_of(F.col("words")))
    length = BLOCK + 1
    last = F.greatest(F.size("shingles") - length, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("shingles", i + 1, F.lit(length)))
    listed = listed.withColumn("bands", F.flatten(F.transform(pieces, _band_minima)))
    shingles: dict[str, list[int]] = {}
    keys: dict[int, list[str]] = {}
    for row in listed.select("name", "shingles", "bands").collect():
        if row["shingles"]:
            shingles[row["name"]] = list(dict.fromkeys(row["shingles"]))
            for key in dict.fromkeys(row["bands"]):
                keys.setdefault(key, []).append(row["name"])
    return shingles, keys


def scan_licences(
    documents: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    templates: dict[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """The ``keep`` columns with ``licences``, the sorted names of the templates that a text holds.

    A text holds a template if some stretch of as many consecutive shingles as the template has
    distinct ones contains at least ``containment`` of those. Stretches are tried around each window
    that retrieves the template.

    A null, empty or too short text holds none; several copies of a notice count once; templates of
    fewer than ``SHINGLE`` words are never found; repeated rows are scanned alike; an empty table gives
    an empty result.
    """
    shingles, keys = load_templates(documents.sparkSession, templates)
    source = with_row(documents, keep, _words=words_of(named(text)))
    source = source.select(ROW, shingles_of(F.col("_words")).alias("_shingles"))
    none = F.array().cast("array<string>")
    if not keys:
        return opened(source.select(ROW, none.alias("licences")))
    blocks = F.ceil(F.size("_shingles") / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda b: F.slice("_shingles", b * BLOCK + 1, F.lit(BLOCK)))
    minima = source.select(ROW, "_shingles", F.transform(cut, _band_minima).alias("_minima"))
    following = F.concat(F.slice("_minima", F.lit(2), F.size("_minima")), F.slice("_minima", F.size("_minima"), F.lit(1)))
    pairs = F.zip_with("_minima", following, lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y)))
    hit = F.transform(pairs, lambda w: F.filter(w, lambda k: k.isin(list(keys))))
    hits = minima.select(ROW, "_shingles", hit.alias("_hits"))

    names = F.create_map(*(x for k, v in keys.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = F.create_map(*(x for k, v in shingles.items() for x in (F.lit(k), _longs(v))))

    def holds(name: Column, window: Column) -> Column:
        wanted = F.element_at(known, name)
        size = F.size(wanted)
        begin = F.greatest(window * BLOCK - size, F.lit(0))
        starts = F.sequence(begin, window * BLOCK + 2 * BLOCK)
        share = lambda at: F.size(F.array_intersect(wanted, F.slice("_shingles", at + 1, size)))
        return F.exists(starts, lambda at: share(at) >= size * F.lit(containment))

    def found(window_hits: Column, window: Column) -> Column:
        retrieved = F.array_distinct(F.flatten(F.transform(window_hits, lambda k: F.element_at(names, k))))
        return F.when(F.size(window_hits) > 0, F.filter(retrieved, lambda name: holds(name, window))).otherwise(none)

    licences = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", found))))
    anything = F.exists("_hits", lambda w: F.size(w) > 0)
    return opened(hits.select(ROW, F.when(anything, licences).otherwise(none).alias("licences")))


def brute_force_sql(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL over ``documents`` that tries every stretch of every text against every template."""
    values = ", ".join(f"('{name}', '{text.lower()}')" for name, text in templates.items())
    return f"""
WITH templates(name, text) AS (VALUES {values}),
template_words AS (SELECT name, regexp_extract_all(text, '[a-z0-9]+') AS w FROM templates),
wanted AS (SELECT DISTINCT name, w[i] || ' ' || w[i + 1] AS s FROM template_words, unnest(range(1, len(w))) AS t(i)),
sizes AS (SELECT name, count(*) AS k FROM wanted GROUP BY name),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
places AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS s FROM words, unnest(range(1, len(w))) AS t(i)),
hits AS (SELECT doc_id, i, name, s FROM places JOIN wanted USING (s)),
stretches AS (
  SELECT a.doc_id, a.name, a.i, count(DISTINCT b.s) AS n, any_value(k) AS k
  FROM hits a JOIN sizes USING (name)
  JOIN hits b ON a.doc_id = b.doc_id AND a.name = b.name AND b.i BETWEEN a.i AND a.i + k - 1
  GROUP BY a.doc_id, a.name, a.i),
held AS (SELECT DISTINCT doc_id, name FROM stretches WHERE n >= k * {containment})
SELECT d.doc_id, count(h.name) AS n_licences, coalesce(string_agg(h.name, ',' ORDER BY h.name), '') AS licences
FROM documents d LEFT JOIN held h ON d.doc_id = h.doc_id GROUP BY d.doc_id
"""
