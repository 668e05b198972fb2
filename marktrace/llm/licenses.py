"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marktrace.llm.common import bind, stored, whole_text
from marktrace.llm.lines import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE_WORDS, PERMUTATIONS, CONTAINMENT = 5, 32, 0.8
#: share of template occurrences that no band may retrieve
MISSED = 1e-6
#: template shingles that a scan may carry as a literal to pass over texts without any of them
LITERAL_SHINGLES = 20_000

#: fixed values: published notices, as name and text
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingles(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the word shingles of a text in order; empty for fewer words than a shingle."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: w) if size == 1 else _shingled(words, size)


def _shingled(words: Column, size: int) -> Column:
    return bind(words, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``name, grams, n, m``: distinct shingles of each template with at least one, their number, and the places they take."""
    rows = spark.createDataFrame([(k, v) for k, v in templates.items()], "name string, body string")
    listed = rows.select("name", shingles(F.coalesce("body", F.lit(""))).alias("all")).withColumn("m", F.size("all")).where("m > 0")
    return listed.select("name", F.array_distinct("all").alias("grams"), F.size(F.array_distinct("all")).alias("n"), "m")


def bands_needed(n: int, m: int, containment: float, least: int) -> int:
    """Bands after which a window of 2 * m places with ``containment`` of n distinct shingles is missed less than once in a million times.

    The window has at most 2 * m shingles, so its similarity to the template is at least the share they have in common then.
    """
    similarity = containment * n / (2 * m + n - containment * n)
    return max(least, math.ceil(math.log(MISSED) / math.log1p(-similarity)))


def band_values(grams: Column, permutations: Column) -> Column:
    """MinHash value of each permutation, one band each: two sets share a band as often as their similarity."""
    return F.transform(F.sequence(F.lit(1), permutations), lambda j: F.array_min(F.transform(grams, lambda g: F.xxhash64(j, g))))


def license_matches(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, permutations: int = PERMUTATIONS, literal_shingles: int = LITERAL_SHINGLES) -> DataFrame:
    """``doc_id, license, containment, first_word, n_windows`` for every template found in a whole text.

    A text is cut into windows of twice the places of a template's shingles, repeated ones included, overlapping
    by half, for each template length, so every occurrence lies whole in a window. Bands of one MinHash value
    each retrieve templates, ``permutations`` or, for templates that repeat themselves, as many as ``bands_needed``
    says: a window that holds 80 % of a template is missed less than once in a million times. The share of the
    template's distinct shingles in the window is then counted exactly and must reach ``containment``.
    ``containment`` is the best window's, ``first_word`` the place of the first template shingle in the
    earliest matching window, ``n_windows`` the number of matching windows.

    Texts and windows without any template shingle cannot share a band and are passed over, by a literal where
    all shingles fit into ``literal_shingles``. Null and short texts have no windows; templates of fewer words than
    a shingle are ignored. Rows that repeat an id and text are one document here; rows of one id with other
    texts are separate, as are rows without id. Other columns are not read.
    """
    known = stored(templates, "license-templates")
    lengths = known.groupBy("m").agg(F.min("n").alias("n")).orderBy("m").collect()
    sizes = {r["m"]: bands_needed(r["n"], r["m"], containment, permutations) for r in lengths}
    bands_of = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map().cast("map<int, int>")
    all_grams = known.select(F.explode("grams").alias("g")).distinct()
    some = [r["g"] for r in all_grams.limit(literal_shingles + 1).collect()]
    near = (lambda g: F.arrays_overlap(g, F.lit(some).cast("array<bigint>"))) if len(some) <= literal_shingles else (lambda g: F.size(g) > 0)
    none = F.array().cast("array<array<bigint>>")
    # a list of one or no element, so that shingles are made once and not again for a filter
    chosen = bind(shingles(whole_text()), lambda g: F.when(near(g), F.array(g)).otherwise(none)) if some else none
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), F.explode(chosen).alias("grams"))
    texts = stored(texts, "license-texts")
    cut = F.array(*(F.lit(n) for n in sizes)) if sizes else F.array().cast("array<int>")
    # windows without any template shingle share no band, so only those around one are looked at
    hit = (lambda g: F.array_contains(F.lit(some).cast("array<bigint>"), g)) if some and len(some) <= literal_shingles else (lambda g: F.lit(True))
    places = F.array_compact(F.transform("grams", lambda g, i: F.when(hit(g), i)))
    around = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(F.floor(p / F.col("m")) * F.col("m"), (F.floor(p / F.col("m")) - 1) * F.col("m")))))
    starts = F.transform(F.filter(around, lambda k: k >= 0), lambda k: k.cast("int"))
    placed = texts.select("*", places.alias("places"))
    wide = placed.select("*", F.explode(cut).alias("m")).select("doc_id", "text_key", "grams", "m", F.explode(starts).alias("at"))
    windows = wide.select("doc_id", "text_key", "m", "at", F.slice("grams", F.col("at") + 1, F.col("m") * 2).alias("window"))
    banded = windows.select("*", F.posexplode(band_values(F.col("window"), F.element_at(bands_of, F.col("m")))).alias("band", "value"))
    wanted = known.select(F.col("name").alias("license"), "n", "m", F.posexplode(band_values(F.col("grams"), F.element_at(bands_of, F.col("m")))).alias("band", "value"))
    met = banded.join(wanted, ["m", "band", "value"]).select("doc_id", "text_key", "at", "window", "license", "n").dropDuplicates(["doc_id", "text_key", "at", "license"])
    counted = met.join(known.select(F.col("name").alias("license"), F.col("grams").alias("template")), "license")
    counted = counted.withColumn("share", F.size(F.array_intersect("template", "window")) / F.col("n")).where(F.col("share") >= containment)
    first = F.col("at") + F.array_min(F.transform("template", lambda g: F.coalesce(F.nullif(F.array_position("window", g), F.lit(0).cast("long")), F.lit(2**31).cast("long")))) - 1
    placed = counted.withColumn("first_word", first)
    return placed.groupBy("doc_id", "text_key", "license").agg(F.max("share").alias("containment"), F.min("first_word").alias("first_word"), F.count("*").alias("n_windows")).drop("text_key")
