"""License scan by MinHash bands over overlapping text windows, verified by exact shingle containment.

Built-in DataFrame functions only. Templates are grouped by length; for each length class a text is
cut into windows a little longer than the template that overlap so much that one of them holds any
occurrence whole. Windows and templates that agree in a band of their MinHash signatures are
compared exactly: a license is reported if a window holds 80 % or more of its template's shingles.

Only windows with a word of LICENSE_WORDS are hashed. That loses nothing: in every template, over
20 % of the shingles have such a word (checked by plan()), so a window without one can't hold 80 %.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINED = 5, 0.8
#: Signature of BANDS bands of ROWS values each.
BANDS, ROWS = 16, 1
#: Least probability that a window holding CONTAINED of a template meets it in a band.
LEAST_PROBABILITY = 0.999

# Notices by which texts state their license (public texts).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No license is granted."),
)
LICENSE_WORDS = (
    "license licenses licensed sublicense software copyright permission permitted redistribute redistribution redistributions released reserved rights public domain source "
    "granted unencumbered"
).split()
#: Window classes: templates of up to so many words. Longer ones make a class of their own.
CLASSES = (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20, 22, 24, 28, 32, 36, 40, 44, 48, 56, 64)


def words_of(text: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def probability(n: int, window: int, bands: int = BANDS, rows: int = ROWS, contained: float = CONTAINED) -> float:
    """Of meeting in a band, for a window of `window` shingles that holds `contained` of a template's n."""
    both = contained * n
    return 1 - (1 - (both / (n + window - both)) ** rows) ** bands


def plan(templates: tuple = TEMPLATES) -> list[tuple[int, str, str, int, int, list[str]]]:
    """(template number, license, kind of notice, class, step, shingles); checks that no window is lost."""
    out = []
    for k, (name, text) in enumerate(templates):
        words = words_of(text)
        size = next((c for c in CLASSES if c >= len(words)), len(words))
        step = max(1, size // 8)
        shingles = sorted({" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})
        marked = sum(bool(set(s.split(" ")) & set(LICENSE_WORDS)) for s in shingles)
        if len(words) < SHINGLE or marked <= (1 - CONTAINED) * len(shingles):
            raise ValueError(f"too few license words or words: {text}")
        if probability(len(shingles), size + step - 1 - SHINGLE + 1) < LEAST_PROBABILITY:
            raise ValueError(f"its windows may be missed: {text}")
        out.append((k, name, text, size, step, shingles))
    return out


def _bands(shingles: Column) -> Column:
    """Hashes of the signature's bands. Each value is the least of the shingles' hashes under one seed."""

    def least_of(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(k))))

    least = [least_of(k) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _shingles(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _templates(spark: SparkSession, templates: tuple) -> DataFrame:
    rows = [(k, name, size, shingles) for k, name, _, size, _, shingles in plan(templates)]
    table = spark.createDataFrame(rows, "template int, license string, class int, wanted array<string>")
    return table.withColumn("band", F.explode(_bands(F.col("wanted"))))


def windows(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, class, start, words) of every window with a license word."""
    sizes = sorted({(size, step) for _, _, _, size, step, _ in plan(templates)})
    marks = "|".join(LICENSE_WORDS)
    text = F.lower("text")
    told = docs.filter(text.rlike(f"(?<![a-z0-9])(?:{marks})(?![a-z0-9])")).select("doc_id", F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ").alias("words"))
    known = F.array(*[F.lit(w) for w in LICENSE_WORDS])
    hits = told.select("doc_id", "words", F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(known, w), i)), lambda i: i.isNotNull()).alias("hits"))

    def starts(size: int, step: int) -> Column:
        # windows begin at multiples of step; those that hold word p begin in (p - width, p]
        width = size + step - 1
        last = F.greatest(F.ceil((F.size("words") - F.lit(width)) / step) * step, F.lit(0)).cast("int")
        each = F.transform("hits", lambda p: F.sequence(F.least(F.greatest(F.ceil((p - F.lit(width) + 1) / step) * step, F.lit(0)).cast("int"), last), F.least((F.floor(p / step) * step).cast("int"), last), F.lit(step)))
        return F.transform(F.array_distinct(F.flatten(each)), lambda s: F.struct(F.lit(size).alias("class"), s.alias("start"), F.lit(width).alias("width")))

    cut = hits.select("doc_id", "words", F.explode(F.concat(*[starts(*x) for x in sizes])).alias("w"))
    return cut.select("doc_id", "w.class", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.width")).alias("words")).filter(F.size("words") >= SHINGLE)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, n_places): for each text and license, the greatest containment of a template and in how
    many windows one was found.

    Null and empty texts state no license; null ids count as one text; repeated rows count their windows once;
    extra columns are ignored; an empty table gives no rows. The template table is fixed, so its broadcast is
    bounded by its size.
    """
    cut = windows(docs, templates).distinct().withColumn("held", _shingles(F.col("words"))).drop("words")
    banded = cut.withColumn("band", F.explode(_bands(F.col("held"))))
    met = banded.join(F.broadcast(_templates(docs.sparkSession, templates)), ["class", "band"])
    part = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    exact = met.select("doc_id", "license", "template", "class", "start", part.alias("containment")).filter(F.col("containment") >= CONTAINED)
    places = exact.distinct().groupBy("doc_id", "license", "template").agg(F.max("containment").alias("containment"), F.count("*").alias("n"))
    return places.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.sum("n").alias("n_places"))


