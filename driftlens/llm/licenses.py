"""Licence scan: Dice coefficient over word bigrams between text units and licence templates.

The units of a document are its lines, its paragraphs (parted by empty lines) and the whole text.
A unit and a template are compared only if their sizes allow the threshold, and a unit is normalised
only if it holds a pair of words without which no template can reach the threshold. Everything runs inside
one projection of built-in functions: no shuffle, no join, no row is multiplied.

Defined results: a null or empty text has no match; texts are read whole, however long; units of one
word have no bigram and match nothing; a unit counts for its best template (ties: the earlier
template); repeated rows are scanned each; extra columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85

# The notices by which these licences are commonly declared.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def normal_words(text: str) -> list[str]:
    """Lower case, ``licence`` as ``license``, everything but ASCII letters and digits as a break."""
    return re.sub("[^a-z0-9]+", " ", text.lower().replace("licence", "license")).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, str]]:
    """Word pairs such that any unit that reaches the threshold with some template contains one of them.

    A match shares at least t*n/(2-t) of a template's n bigrams, so of any larger number than it may
    miss it holds one; the longest are taken, for they are the rarest.
    """
    chosen: dict[tuple[str, str], None] = {}
    for _, text in templates:
        grams = bigrams(normal_words(text))
        needed = int(-(-threshold * len(grams) // (2 - threshold)))
        for gram in sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - needed + 1]:
            first, second = sorted(gram.split(), key=len, reverse=True)
            chosen[first, second] = None
    return list(chosen)


def _lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("licence"), F.lit("license"))


def _may_match(low: Column) -> Column:
    test = F.lit(False)
    for long, short in anchors():
        test = test | (F.contains(low, F.lit(long)) & F.contains(low, F.lit(short)))
    return test


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.element_at(words, i + 2)))
    return F.array_distinct(pairs)


def _templates() -> Column:
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        grams = bigrams(normal_words(text))
        rows.append(F.struct(F.lit(-i).alias("priority"), F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")))
    return F.array(*rows)


def scan(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (matching units), licenses (sorted, distinct) and best_dice of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower-cased once, before anything is split: what case folding and spelling change is no line break
    step = documents.select("doc_id", _lower(text).alias("text"))
    step = step.select("doc_id", F.when(_may_match(F.col("text")), F.col("text")).alias("text"))
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", "\n\\s*\n"), lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = F.filter(F.array_distinct(F.concat(lines, paragraphs, whole)), _may_match)
    step = step.select("doc_id", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(units).alias("units"))
    clean = F.transform("units", lambda u: F.split(F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")), " "))
    step = step.select("doc_id", clean.alias("words"))
    short = F.filter("words", lambda w: F.size(w) >= 2)
    step = step.select("doc_id", F.transform(short, _bigrams).alias("grams"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def best(grams: Column) -> Column:
        near = F.filter(_templates(), lambda t: (F.size(grams) >= low * t["n"]) & (F.size(grams) <= high * t["n"]))
        dice = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])).alias("dice"), t["priority"].alias("priority"), t["name"].alias("name")))
        return F.array_max(dice)

    step = step.select("doc_id", F.transform("grams", best).alias("found"))
    step = step.select("doc_id", F.filter("found", lambda f: f["dice"] >= threshold).alias("found"))
    return step.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["name"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same scan for DuckDB, without the pruning."""
    rows = ", ".join("({}, '{}', [{}])".format(-i, name, ", ".join(f"'{g}'" for g in bigrams(normal_words(text)))) for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH templates(priority, name, grams) AS (VALUES {rows}),
units AS (
  SELECT DISTINCT doc_id, replace(lower(unit), 'licence', 'license') AS unit FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS unit FROM documents) WHERE contains(unit, chr(10))
    UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10)))),
words AS (
  SELECT doc_id, unit, string_split(trim(regexp_replace(unit, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2),
dice AS (
  SELECT doc_id, unit, priority, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams CROSS JOIN templates),
best AS (
  SELECT doc_id, unit, arg_max(name, (dice, priority)) AS name, max(dice) AS dice FROM dice WHERE dice >= {threshold} GROUP BY doc_id, unit)
SELECT d.doc_id, count(b.unit) AS n_matches, coalesce(array_to_string(list_sort(list(DISTINCT b.name) FILTER (b.name IS NOT NULL)), ','), '') AS licenses,
       round(coalesce(max(b.dice), 0.0), 6)::DOUBLE AS best_dice
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id GROUP BY d.doc_id
"""
