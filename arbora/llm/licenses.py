"""License scans: Dice coefficient over word bigrams, natively.

A text's units are its lines and its paragraphs (split at blank lines). A unit is normalised (A-Z lower-cased, everything
but words made one space) and compared to the templates by ``2 |A & B| / (|A| + |B|)`` over sets of word bigrams. A
coefficient of t needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``, so templates out of that range aren't compared.
Everything happens within a row: no shuffle, no Python.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Identifiers and texts of licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    import re

    words = re.sub(SEPARATORS, " ", text.translate(str.maketrans(UPPER, LOWER))).strip().split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold with a set of n."""
    return ceil(n * threshold / (2 - threshold) - 1e-9), floor(n * (2 - threshold) / threshold + 1e-9)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_rows(templates: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[str, list[str], int, int]]:
    return [(name, grams, *size_bounds(len(grams), threshold)) for name, text in templates if (grams := bigrams(text))]


def matches(text: F.Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> F.Column:
    """array<struct<license, dice, words>> of the units that reach the threshold, best template each.

    Of equal coefficients the first identifier wins. Equal units count once. Null text gives an empty array.
    """
    rows = "array(" + ",".join(f"struct({_quote(n)} as name, array({','.join(map(_quote, g))}) as grams, {lo} as lo, {hi} as hi)" for n, g, lo, hi in template_rows(templates, threshold)) + ")"
    most = max((hi for *_, hi in template_rows(templates, threshold)), default=0)
    least = min((lo for *_, lo, _ in template_rows(templates, threshold)), default=0)
    lines = F.array_union(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"))
    normal = F.transform(lines, lambda u: F.trim(F.regexp_replace(F.translate(u, UPPER, LOWER), SEPARATORS, " ")))
    words = F.filter(F.transform(F.array_distinct(normal), lambda u: F.split(u, " ")), lambda w: F.size(w) > least)
    grams = F.transform(words, lambda w: F.struct(F.size(w).alias("words"), F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))).alias("grams")))
    grams = F.filter(grams, lambda g: F.size(g["grams"]) <= most)

    def best(g: F.Column) -> F.Column:
        fits = F.filter(F.expr(rows), lambda t: F.size(g["grams"]).between(t["lo"], t["hi"]))
        scored = F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(g["grams"], t["grams"])) / (F.size(g["grams"]) + F.size(t["grams"]))).alias("loss"), t["name"].alias("name")))
        low = F.array_min(scored)
        return F.struct(low["name"].alias("license"), (-low["loss"]).alias("dice"), g["words"].alias("words"))

    return F.coalesce(F.filter(F.transform(grams, best), lambda m: m["dice"] >= threshold), F.expr("cast(array() as array<struct<license:string,dice:double,words:int>>)"))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "license_matches") -> DataFrame:
    """docs with ``out_col``, the matches in each whole text; a column of that name is replaced.

    Null, empty and one-word texts match nothing; repeated rows each get their matches; an empty table stays empty.
    """
    return docs.withColumn(out_col, matches(F.col(text_col).cast("string")))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, license (best match, else null), dice, n_matches, licenses (sorted, comma-joined)."""
    found = docs.select(F.col(id_col).alias("doc_id"), matches(F.col(text_col).cast("string")).alias("m"))
    best = F.array_min(F.transform("m", lambda x: F.struct((-x["dice"]).alias("loss"), x["license"].alias("name"))))
    return found.select("doc_id", best["name"].alias("license"), (-best["loss"]).alias("dice"), F.size("m").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("m.license"))), ",").alias("licenses"))
