"""Operator 10, license scan: MinHash bands over text windows, exact containment afterwards.

Main path: DataFrame functions only. Words are compared lower-cased and without punctuation at
their ends. A template's text is a set of shingles (m of them) of 5 words, or of its own words if it has fewer.
A text that holds less than ``CONTAINMENT`` of a template's size in shingles of templates of that size
cannot match and goes no further. The others are cut into windows, ``max(1, m // STEPS)`` shingles
apart and longer than m by that less one, so that any run of m shingles lies in a window, and an exact copy in one that
holds the template's whole shingle set. A window and a template meet when one of ``BANDS`` single-row
MinHash bands agrees: at a Jaccard similarity of 0.65, which a containment of 0.8 means in a
window longer by 1 / ``STEPS``, that is missed with probability 0.35 ** BANDS < 1e-7.
What meets is verified in the window widened by ``WIDEN`` of the template's size on either side, so that words inserted
into a copy (up to half as many as it has) do not push its end out: the share of the template's shingles there must be at
least ``CONTAINMENT``. A window that holds only half of the template's shingles is still missed with less than 0.002.
A window without any template shingle can agree in no band, so such windows make no signature; that loses nothing.

Windows that verify are grouped into places: the one with most shingles of its own stands for all that begin less than m
from it, then the best of the others, and so on. A text with two copies of a license has two rows. Copies that begin less
than m apart are one place.

Defined results: null or empty texts match nothing; a template without words is an error; repeated rows are
reported each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import WORD, cut_lineage, row_keyed, table

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
#: Windows of a long template start this share of its size apart.
STEPS = 64
#: A window is verified with this share of the template's size more on either side.
WIDEN = 0.5
#: Up to this many hits, texts are looked up by a broadcast of the hits (under 100 bytes each).
BROADCAST_HITS = 1_000_000
#: Complete license texts, in ``license_texts/``.
TEXTS = ("Apache-2.0", "Artistic", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT",
         "MPL-1.1", "MPL-2.0")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by "
        "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
#: License notices and texts that are looked for (name, text); a parameter of ``scan``.
TEMPLATES = (
    ("AGPL-3.0-header", _GNU.format("Affero", "3")),
    ("All-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-2.0-header", _GNU.format("", "2").replace("software:", "software;")),
    ("GPL-3.0-header", _GNU.format("", "3")),
    ("LGPL-2.1-header", _GNU.format("Lesser", "2.1").replace("program", "library").replace("software:", "software;")),
    ("LGPL-3.0-header", _GNU.format("Lesser", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((f"{name}-text", pkgutil.get_data(__package__, f"license_texts/{name}-text.txt").decode()) for name in TEXTS),
)


def _words(text: Column) -> Column:
    """Lower-cased words without the punctuation at their ends; words of punctuation only are kept as they are."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)|(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.regexp_extract_all(spaced, F.lit(WORD), F.lit(0))


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of all n-word shingles, in order."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))),
                       lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))


def _bands(shingles: Column) -> Column:
    """MinHash values, one for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> list:
    """``(license, n, w, t, m, bands)``: the words of a shingle, the words of a template of one shingle, the
    shingle set of every template, its size, its bands."""
    if not templates:
        return []
    rows = spark.createDataFrame(list(templates), "license string, _t string").select("license", _words(F.col("_t")).alias("w"))
    every = F.array(*[_shingles(F.col("w"), n) for n in range(1, SHINGLE + 1)])
    rows = rows.select("license", F.least(F.size("w"), F.lit(SHINGLE)).alias("n"), "w", every.alias("every")).collect()  # the parameter's rows
    if any(r["n"] < 1 for r in rows):
        raise ValueError("a license template without words")
    sets = [(r["license"], r["n"], r["w"][:SHINGLE], sorted(set(r["every"][r["n"] - 1]))) for r in rows]
    sets = [(name, n, w, t, len(t)) for name, n, w, t in sets]
    return spark.createDataFrame(sets, "license string, n int, w array<string>, t array<long>, m int").withColumn("bands", _bands(F.col("t"))).collect()


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document, license and place: ``doc_id, license, first_word, n_words, containment, n_windows``."""
    spark = docs.sparkSession
    fixed = template_table(spark, templates)
    if not fixed:
        return spark.createDataFrame([], "doc_id long, license string, first_word long, n_words long, containment double, n_windows long")
    known = spark.createDataFrame(sorted({(x, r["n"], r["m"]) for r in fixed for x in r["t"]}), "x long, n int, m int")
    lengths = sorted({r["n"] for r in fixed}, reverse=True)
    keyed = row_keyed(docs.select("doc_id", "text")).select("__file", "__place", "_row.*")
    key = ["__file", "__place"]
    # shingles of all lengths, one after the other; a hit's template tells its length
    d = keyed.select(*key, _words(F.coalesce("text", F.lit(""))).alias("w"))
    # short shingles only of texts that hold all words of a short template
    short = F.lit(False)
    for r in fixed:
        if r["n"] < SHINGLE:
            every = F.lit(True)
            for word in set(r["w"]):
                every &= F.array_contains("w", word)
            short |= every
    made = [_shingles(F.col("w"), n) if n == SHINGLE else F.when(short, _shingles(F.col("w"), n)).otherwise(F.array().cast("array<long>")) for n in lengths]
    d = d.select(*key, F.size("w").alias("n_w"), F.posexplode(F.concat(*made)).alias("pos", "x"))
    before = F.lit(0)
    at = F.lit(None).cast("int")
    for n in lengths:
        at = F.when(F.col("n") == n, F.col("pos") - before).otherwise(at)
        before = before + F.greatest(F.col("n_w") - (n - 1), F.lit(0))
    hits = d.join(F.broadcast(known), "x").select(*key, "n", "m", "x", at.alias("at"))
    hits = hits.groupBy(*key, "n", "m").agg(F.sort_array(F.collect_set("at")).alias("hits"), F.size(F.collect_set("x")).alias("held"))
    hits = cut_lineage(hits.where(F.col("held") >= F.col("m") * containment - 1e-9).drop("held"))
    few = hits.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_HITS
    hits = hits.select(F.col("__file").alias("_f"), F.col("__place").alias("_p"), "n", "m", "hits")
    step = F.greatest(F.floor(F.col("m") / STEPS), F.lit(1)).cast("int")
    met = keyed.join(F.broadcast(hits) if few else hits, (F.col("__file") == F.col("_f")) & (F.col("__place") == F.col("_p"))).drop("_f", "_p")
    met = met.withColumn("step", step).withColumn("w", _words(F.coalesce("text", F.lit("")))).drop("text")
    of_length = F.lit(None).cast("array<long>")
    for n in lengths:
        of_length = F.when(F.col("n") == n, _shingles(F.col("w"), n)).otherwise(of_length)
    marked = met.select("doc_id", *key, "n", "m", "step", "hits", of_length.alias("s"))
    # windows that hold a hit: starts up to m - 1 before it
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(
        F.floor(F.greatest(i - (F.col("m") - 1), F.lit(0)) / F.col("step")).cast("int"), F.floor(i / F.col("step")).cast("int")))))
    fields = [(r["license"], r["n"], r["m"], r["bands"], r["t"]) for r in fixed]
    known = spark.createDataFrame(fields, "license string, n int, m int, bands array<long>, t array<long>")
    rows = marked.withColumn("starts", starts).join(F.broadcast(known), ["n", "m"])  # as many rows as the parameter has
    more = F.ceil(F.col("m") * WIDEN).cast("int")
    length = F.col("m") + F.col("step") - 1

    def part(first: Column, n: Column) -> Column:
        return F.array_distinct(F.slice("s", F.greatest(first, F.lit(0)) + 1, n))

    def agrees(at: Column) -> Column:
        same = lambda v: F.exists(F.zip_with(_bands(v), "bands", lambda x, y: x == y), lambda e: e)
        return F.exists(F.array(part(at, length)), same)

    def held(v: Column) -> Column:
        return F.size(F.array_intersect("t", v)) / F.size("t")

    places = F.filter(F.transform("starts", lambda i: (i * F.col("step")).cast("int")), agrees)
    found = F.transform(places, lambda at: F.struct((-held(part(at, length))).alias("own"), at.alias("at"), held(part(at - more, length + 2 * more)).alias("share")))
    rows = rows.select("doc_id", "license", "n", "m", F.sort_array(F.filter(found, lambda c: c["share"] >= containment)).alias("good"))
    none = F.array().cast(rows.schema["good"].dataType)
    apart = F.aggregate("good", none, lambda kept, c: F.when(F.exists(kept, lambda k: F.abs(k["at"] - c["at"]) < F.col("m")), kept)
                        .otherwise(F.concat(kept, F.array(c))))
    rows = rows.select("doc_id", "license", "n", "m", "good", F.explode(apart).alias("p"))
    around = F.size(F.filter("good", lambda c: F.abs(c["at"] - F.col("p.at")) < F.col("m"))).cast("long")
    return rows.select("doc_id", "license", F.col("p.at").cast("long").alias("first_word"), (F.col("m") + F.col("n") - 1).cast("long").alias("n_words"),
                       F.col("p.share").alias("containment"), around.alias("n_windows"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
