"""License scan: MinHash bands over overlapping text windows and exact shingle hashes retrieve templates, exact shingle
containment verifies them.

Words are lower-case runs of letters and digits, shingles five words. A window has ``WINDOW`` shingles and starts every
``STRIDE``, so neighbours share shingles. One band is one row: the least of the window's shingle hashes under one of
``BANDS`` hash functions (XXH64 with the band's number). Bands alone can miss a short notice whatever their number, so the
table also has each template's shingle hashes themselves, and each shingle of a text is looked up: a text that holds any
shingle of a template retrieves it, with no chance of a miss. Retrieved templates are kept if the document holds at least
``CONTAINED`` of their shingles. Everything is native; the values of the fixed templates are a small broadcast table.

Defined results: a null text has no words; rows with a null doc_id are scanned alone but verified by no join, so they get
no license; rows that repeat a doc_id share the licenses of all its rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, let, small

SHINGLE, WINDOW, STRIDE, BANDS, CONTAINED = 5, 6, 3, 16, 0.8
#: Public notices of well-known licenses; a license may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
_NOT_WORD = r"[^\p{L}\p{N}]+"


def template_shingles(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda w: w != "")


def _joined_shingles(words: Column) -> Column:
    """The distinct shingles as strings."""
    return F.array_distinct(
        F.transform(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
            lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, SHINGLE)]),
        )
    )


def _pieces() -> list[tuple[int, list[str]]]:
    out = []
    for t, (_, text) in enumerate(TEMPLATES):
        s = template_shingles(text)
        out += [(t, s[i : i + WINDOW]) for i in range(0, len(s), WINDOW)]
    return out


def template_bands(spark: SparkSession) -> DataFrame:
    """value, template: the band values of the templates' pieces and the hashes of their shingles; a small table, fixed by ``TEMPLATES``."""
    pieces = _pieces()
    words = spark.createDataFrame([(i, t, s.split(" ")) for i, (t, ss) in enumerate(pieces) for s in ss], "i int, template int, w array<string>")
    hashes = words.select("i", "template", F.xxhash64(*[F.col("w")[k] for k in range(SHINGLE)]).alias("h"))
    h = hashes.select("*", F.explode(F.array(*map(F.lit, range(BANDS)))).alias("band"))
    bands = h.groupBy("i", "template", "band").agg(F.min(F.xxhash64("h", "band")).alias("value"))
    return bands.select("value", "template").union(hashes.select("h", "template")).distinct()


def _windows(docs: DataFrame) -> DataFrame:
    """doc, s (the shingle hashes of a window, the last one repeated where a text ends), for each window."""

    def cut(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)])
        )
        return let(
            hashes,
            lambda h: F.when(F.size(h) == 0, F.array().cast("array<array<bigint>>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(STRIDE)), lambda i: F.slice(h, i + 1, F.lit(WINDOW)))
            ),
        )

    windows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.explode(let(_words(F.col("text")), cut)).alias("s"))
    return windows.select("doc", *[F.coalesce(F.get("s", F.lit(i)), F.get("s", F.lit(0))).alias(f"s{i}") for i in range(WINDOW)])


def retrieve(docs: DataFrame) -> DataFrame:
    """doc, template: what any band of any window, or any shingle, retrieves."""
    least = [F.least(*[F.xxhash64(F.col(f"s{i}"), F.lit(k)) for i in range(WINDOW)]) for k in range(BANDS)]
    own = [F.col(f"s{i}") for i in range(STRIDE)]  # the first shingles of all windows are all shingles
    values = _windows(docs).select("doc", F.explode(F.array(*least, *own)).alias("value"))
    return values.join(F.broadcast(template_bands(docs.sparkSession)), "value").select("doc", "template").distinct()


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted names, comma-joined) for each row of ``docs``."""
    found = cut_lineage(retrieve(docs))
    held = small(found.groupBy("doc").agg(F.collect_set("template").alias("ts")))
    templates = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, template_shingles(text))).alias("shingles")) for name, text in TEMPLATES])
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text").join(held, "doc")
    names = let(
        let(_words(F.col("text")), _joined_shingles),
        lambda s: F.transform(
            F.filter(
                F.transform(F.col("ts"), lambda t: F.get(templates, t)),
                lambda t: F.size(F.array_intersect(t["shingles"], s)) >= F.size(t["shingles"]) * F.lit(CONTAINED),
            ),
            lambda t: t["name"],
        ),
    )
    verified = texts.select("doc", F.explode(names).alias("name")).groupBy("doc").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(verified, F.col("doc_id") == F.col("doc"), "left").select(
        "doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses")
    )
