"""Licence notices anywhere in a text: Dice over word bigrams between windows of words and templates.

A window is any run of words, across lines and sentences, of at most (2 - t) / t times a template's
bigrams. Of the windows that reach the threshold t with some template, the best is taken, then the best of those
that do not overlap it, and so on (ties: the longer template, the earlier template, the earlier window),
so a notice counts once and for the licence it is nearest to. A best window starts and ends with a bigram
of its template, for cutting other words off its ends never lowers the coefficient.

Everything runs inside one projection of built-in functions: no shuffle, no join, no row is multiplied.

Defined results: a null or empty text has no notice; texts are read whole, however long; repeated rows
are scanned each; extra columns are never read. Bodies of the GNU licences and of Apache-2.0 are known
by their titles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import TEMPLATES, THRESHOLD, _lower, bigrams, normal_words

_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(kind: str, version: str) -> str:
    what = "library" if kind.startswith("Lesser") else "program"
    name = f"GNU {kind}General Public License"
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."


# The templates of the line scan, then bodies, headers and titles. None is a part that two licences share.
NOTICES: list[tuple[str, str]] = TEMPLATES + [
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("GPL-2.0", _gnu("", "2")),
    ("GPL-3.0", _gnu("", "3")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1")),
    ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("AGPL-3.0", _gnu("Affero ", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
]


def needed(n: int, threshold: float) -> int:
    """The fewest common bigrams with which a template of ``n`` bigrams can reach the threshold."""
    return math.ceil(round(threshold * n / (2 - threshold), 9))


def widest(n: int, threshold: float) -> int:
    return math.floor(round(n * (2 - threshold) / threshold, 9))


def marks(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which any window that reaches the threshold with some template holds one.

    For each template, words are taken until the bigrams without any of them are too few for a match.
    """
    chosen: dict[str, None] = {}
    for _, text in templates:
        grams = [g.split() for g in bigrams(normal_words(text))]
        left = [g for g in grams if not any(c in w for c in chosen for w in g)]
        while len(left) >= needed(len(grams), threshold):
            words = dict.fromkeys(w for g in left for w in g)
            word = max(words, key=lambda w: (min(len(w), 7), sum(w in g for g in left), w))
            chosen[word] = None
            left = [g for g in left if not any(word in w for w in g)]
    return [w for w in chosen if not any(v != w and v in w for v in chosen)]


def _windows(hits: Column, grams: Column, order: int, name: str, own: list[str], threshold: float) -> Column:
    """Windows of one template that reach the threshold, from the places of bigrams of any template."""
    n, least, most = len(own), needed(len(own), threshold), widest(len(own), threshold)
    mine = F.filter(hits, lambda h: h["gram"].isin(own))

    def ending(run: Column, start: Column) -> Column:
        ends = F.filter(F.transform(run, lambda h, j: F.struct(h["at"].alias("at"), j.alias("j"))), lambda e: (e["j"] >= least - 1) & (e["at"] - start < most))

        def score(e: Column) -> Column:
            common = F.size(F.array_distinct(F.transform(F.slice(run, F.lit(1), e["j"] + 1), lambda h: h["gram"])))
            held = F.size(F.array_distinct(F.slice(grams, start + 1, e["at"] - start + 1)))
            return F.struct((2.0 * common / (held + n)).alias("dice"), F.lit(n).alias("n"), F.lit(-order).alias("priority"), (-start).alias("start"), e["at"].alias("end"), F.lit(name).alias("name"))

        return F.filter(F.transform(ends, score), lambda c: c["dice"] >= threshold)

    def windows(m: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(m) - least, F.lit(0))), lambda i: F.slice(m, i + 1, F.lit(most)))
        return F.flatten(F.transform(F.filter(runs, lambda r: F.size(r) >= least), lambda r: ending(r, F.element_at(r, 1)["at"])))

    # an array of one binds the template's own hits, so that they are found once
    return F.when(F.size(hits) >= least, F.flatten(F.transform(F.array(mine), windows)))


def find(documents: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_notices, licenses (sorted, distinct) and best_dice of every document."""
    templates = NOTICES if templates is None else templates
    known = [bigrams(normal_words(t)) for _, t in templates]
    step = documents.select("doc_id", _lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    test = F.lit(False)
    for word in marks(templates, threshold):
        test = test | F.contains("text", F.lit(word))
    words = F.split(F.trim(F.regexp_replace("text", "[^a-z0-9]+", " ")), " ")
    step = step.select("doc_id", F.when(test, words).otherwise(F.array().cast("array<string>")).alias("words"))
    count = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), count), F.slice("words", F.lit(2), count), lambda a, b: F.concat(a, F.lit(" "), b))
    step = step.select("doc_id", pairs.alias("grams"))
    every = sorted({g for own in known for g in own})
    hits = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(every))
    step = step.select("doc_id", "grams", hits.alias("hits"))
    found = [_windows(F.col("hits"), F.col("grams"), i, name, own, threshold) for i, ((name, _), own) in enumerate(zip(templates, known, strict=True)) if own]
    step = step.select("doc_id", F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("found"))
    ranked = F.reverse(F.array_sort("found"))
    kind = "array<struct<dice:double,n:int,priority:int,start:int,end:int,name:string>>"
    free = F.aggregate(ranked, F.array().cast(kind), lambda kept, c: F.when(F.exists(kept, lambda k: (-k["start"] <= c["end"]) & (-c["start"] <= k["end"])), kept).otherwise(F.concat(kept, F.array(c))))
    step = step.select("doc_id", free.alias("kept"))
    return step.select(
        "doc_id",
        F.size("kept").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("kept", lambda c: c["name"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("kept", lambda c: c["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )
