"""Operator 1: license scans, in DataFrame functions only.

Texts are cut into overlapping windows of WINDOW words, STRIDE apart. Each window has one
MinHash value in each of BANDS bands (one row a band) over its 3-word shingles. Templates are cut
at every word, so a window inside a quoted template has a template window equal to it. A
passage of up to STRIDE + 1 words lies whole in some window, where it makes half of the
shingles: one band agrees with probability 1 - (1 - 1/2) ** 16 > 0.9999; with a third of the
shingles shared, still 0.998. Windows that agree retrieve the template, and the share of the
template's shingles that the surrounding text holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencelake.llm.decontamination import all_small, word_hashes
from evidencelake.scratch import is_small

SHINGLE, WINDOW, STRIDE, BANDS = 3, 8, 4, 16
PER_WINDOW = WINDOW - SHINGLE + 1
CONTAINMENT = 0.8
MAX_BROADCAST_BANDS = 1_000_000
#: License, form of notice and text (fixed values: wording of public license notices).
TEMPLATES = [
    ("MIT", "short", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "short", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL", "short", "This work is licensed under the GNU General Public License"),
    ("GPL", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC", "short", "Licensed under CC BY-NC"),
    ("CC-BY-SA", "short", "Licensed under CC BY-SA"),
    ("CC-BY", "long", "This work is licensed under a Creative Commons Attribution"),
    ("CC0", "long", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``license, form, text`` of the templates; the list is a parameter, not corpus data."""
    rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("form"), F.lit(c).alias("text")) for a, b, c in templates])
    return spark.range(1).select(F.inline(rows))


def _shingle_array(h: str) -> Column:
    places = F.when(F.size(h) >= SHINGLE, F.sequence(F.lit(0), F.size(h) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))


def windows(rows: DataFrame, stride: int) -> DataFrame:
    """``rows`` (with ``s``, shingles) once for each window and band: adds ``at`` and ``band``. The last window may be short."""
    last = F.greatest(F.size("s") - PER_WINDOW + stride - 1, F.lit(0))
    each = rows.withColumn("at", F.explode(F.when(F.size("s") > 0, F.sequence(F.lit(0), last, F.lit(stride)))))
    inside = each.withColumns({f"__s{i}": F.get("s", F.col("at") + i) for i in range(PER_WINDOW)})
    banded = inside.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    low = F.least(*[F.when(F.col(f"__s{i}").isNotNull(), F.xxhash64(f"__s{i}", "__b")) for i in range(PER_WINDOW)])
    return banded.withColumn("band", F.xxhash64("__b", low)).drop("__b", *[f"__s{i}" for i in range(PER_WINDOW)])


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and template form that it holds: ``doc_id, license, form, containment, first_word``.

    ``containment`` is the share of the template's distinct shingles in the text around a
    retrieved window (a template's length either side), ``first_word`` where the first such window
    begins. Null and empty texts, and texts or templates of fewer than 3 words, give no rows. Repeated
    rows give one row for each document id; null ids are left out; extra columns are not read; an
    empty table gives no rows. Template bands and shingles are broadcast if few by count, else shuffled.
    """
    forms = templates.select("license", "form", word_hashes(F.col("text")).alias("h")).withColumn("s", _shingle_array("h")).drop("h").distinct()
    bands = windows(forms, 1).select("band", "license", "form").distinct()
    held = forms.select("license", "form", F.array_distinct("s").alias("t"))
    texts = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("h")).withColumn("s", _shingle_array("h")).drop("h")
    if is_small(bands, MAX_BROADCAST_BANDS) and all_small(held, "t", MAX_BROADCAST_BANDS):
        hits = windows(texts, STRIDE).join(F.broadcast(bands), "band").drop("band").join(F.broadcast(held), ["license", "form"])
    else:  # only bands, ids and places are shuffled; the windows that agree find text and template by id
        found = windows(texts, STRIDE).select("band", "doc_id", "at").join(bands, "band").select("doc_id", "license", "form", "at").distinct()
        hits = found.join(texts, "doc_id").join(held, ["license", "form"])
    begin = F.greatest(F.col("at") - F.size("t"), F.lit(0))
    around = F.slice("s", begin + 1, 2 * F.size("t") + PER_WINDOW)
    shares = hits.select("doc_id", "license", "form", "at", (F.size(F.array_intersect("t", around)) / F.size("t")).alias("containment"))
    good = shares.where(F.col("containment") >= containment)
    return good.groupBy("doc_id", "license", "form").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the built-in templates."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), template_table(spark)).drop("first_word")


#: Brute force: for every text and template, the best share of template shingles around any common shingle's window grid.
ORACLE = rf"""
WITH t(license, form, text) AS (VALUES {", ".join("('" + "', '".join(x.replace("'", "''") for x in t) + "')" for t in TEMPLATES)}),
tw AS (SELECT license, form, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
ts AS (SELECT license, form, len(w) - 2 AS m, i AS q, w[i:i + 2] AS g FROM tw, unnest(range(1, len(w) - 1)) AS u(i)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, w[i:i + 2] AS g FROM dw, unnest(range(1, len(w) - 1)) AS u(i)),
hit AS (SELECT doc_id, license, form, g, p, p // {STRIDE} * {STRIDE} AS a FROM ds JOIN ts USING (g)),
win AS (SELECT DISTINCT doc_id, license, form, a - {STRIDE} * k AS a0 FROM hit, unnest([0, 1]) AS u(k) WHERE a - {STRIDE} * k >= 0 AND p - (a - {STRIDE} * k) < {PER_WINDOW}),
n AS (SELECT license, form, count(DISTINCT g) AS n FROM ts GROUP BY ALL),
c AS (SELECT doc_id, license, form, a0, count(DISTINCT g) / any_value(n) AS containment FROM win JOIN n USING (license, form) JOIN hit USING (doc_id, license, form)
  WHERE p >= greatest(a0 - n, 0) AND p < greatest(a0 - n, 0) + 2 * n + {PER_WINDOW} GROUP BY ALL)
SELECT doc_id, license, form, max(containment) AS containment FROM c WHERE containment >= {CONTAINMENT} GROUP BY ALL
"""
