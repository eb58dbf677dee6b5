"""Licence scans: whole texts against licence templates by the Dice coefficient of word bigrams.

Everything is a built-in expression.  A text is normalised as a whole (lower case, runs of anything
but letters and digits, line ends among them, become one space), so a notice is found wherever it
stands: alone, within a line, or wrapped over several.  A template of L words is compared with the
windows of L words (fewer at the text's end) that begin at one of its bigrams.

Pruning is exact.  Dice of ``least`` needs least / (2 - least) of the template's bigrams, so

- a text goes on only if it holds a word of which every match of some template holds one,
- a template stays a candidate of a text only if the text holds that part of its bigrams, and
- a window is compared only if so many places of the template's bigrams lie in it, and if the
  number of its own bigrams lies within the bounds of size that the coefficient allows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The notices by which public licences are usually declared, and the texts of short ones.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LEAST_DICE = 0.8


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def needed(grams: int, least_dice: float = LEAST_DICE) -> int:
    """Bigrams of a template of so many that every match shares."""
    return max(1, math.ceil(grams * least_dice / (2 - least_dice) - 1e-9))


def anchor_words(grams: list[str], least_dice: float = LEAST_DICE) -> list[str]:
    """Words of which every match of a template holds one.

    The longest words are taken until the bigrams without any of them are fewer than a match needs.
    """
    chosen: list[str] = []
    for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        if sum(not set(g.split(" ")) & set(chosen) for g in grams) < needed(len(grams), least_dice):
            break
        chosen.append(word)
    return chosen


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _computed(value: Column) -> Column:
    """value, computed once: an explode keeps the optimizer from copying it into each use."""
    return F.explode(F.array(value))


def _bigrams(words: Column) -> Column:
    """The bigrams of a text, one for each word but the last."""
    follow = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(follow, lambda w, i: F.concat_ws(" ", F.element_at(words, (i + 1).cast("int")), w))


def license_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, least_dice: float = LEAST_DICE) -> DataFrame:
    """(key, license, dice, first_word, n_words): per row and licence the best window of any of its templates.

    ``first_word`` counts the words of the normalised text from 0; of equal windows the first one is
    given, of equal templates the longest.  Templates of one word match nothing.  Null or empty
    texts match nothing; null keys stay null; each of repeated rows gives its own result; very long
    texts are compared whole; columns beyond key and text do not matter, whatever their names; an
    empty table gives an empty one.
    """
    made = [(name, template_bigrams(t), len(template_words(t))) for name, t in templates]
    made = [m for m in made if m[1]]
    tight, loose = least_dice / (2 - least_dice), (2 - least_dice) / least_dice
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("license"), F.array(*map(F.lit, g)).alias("grams"), F.lit(long).alias("long"),
                F.lit(needed(len(g), least_dice)).alias("need"), F.lit(len(g) * tight - 1e-9).alias("low"), F.lit(len(g) * loose + 1e-9).alias("high"),
            )
            for name, g, long in made
        ]
    )
    anchors = F.array(*map(F.lit, sorted({w for _, g, _ in made for w in anchor_words(g, least_dice)})))
    any_gram = sorted({x for _, g, _ in made for x in g})
    # Words, of the texts that hold an anchor.
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    rows = rows.select("key", _computed(F.split(normalised(F.col("text")), " ")).alias("words")).filter(F.arrays_overlap("words", anchors))
    rows = rows.select("key", _computed(_bigrams(F.col("words"))).alias("grams"))
    # Places of template bigrams; candidate templates of the text.
    hits = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(any_gram))
    rows = rows.select("key", "grams", _computed(hits).alias("hits")).filter(F.size("hits") > 0)
    rows = rows.select("key", "grams", "hits", _computed(F.array_distinct(F.col("hits.gram"))).alias("held"))
    rows = rows.select("key", "grams", "hits", F.explode(F.filter(listed, lambda t: F.size(F.array_intersect(F.col("held"), t["grams"])) >= t["need"])).alias("t"))
    # Windows: starts at a place p of the template with need - 1 further places within its length.
    own = F.transform(F.filter("hits", lambda h: F.array_contains(F.col("t.grams"), h["gram"])), lambda h: h["at"])
    rows = rows.select("key", "grams", "t", _computed(own).alias("places"))
    crowded = F.filter("places", lambda p, i: F.get("places", (i + F.col("t.need") - 1).cast("int")) - p <= F.col("t.long") - 2)
    rows = rows.select("key", "grams", "t", F.explode(crowded).alias("at"))
    window = F.array_distinct(F.slice("grams", F.col("at") + 1, F.col("t.long") - 1))
    rows = rows.select("key", "t", "at", F.size("grams").alias("total"), _computed(window).alias("own")).filter(F.size("own").between(F.col("t.low"), F.col("t.high")))
    both = F.size(F.array_intersect("own", F.col("t.grams")))
    dice = 2.0 * both / (F.size("own") + F.size("t.grams"))
    words = F.least(F.col("t.long"), F.col("total") + 1 - F.col("at"))
    best = F.max(F.struct(dice.alias("dice"), (-F.col("at")).alias("back"), words.alias("n_words")))
    rows = rows.filter(dice >= least_dice).groupBy("key", F.col("t.license").alias("license")).agg(best.alias("best"))
    return rows.select(F.col("key.key").alias(key), "license", "best.dice", (-F.col("best.back")).cast("long").alias("first_word"), F.col("best.n_words").cast("long").alias("n_words"))
