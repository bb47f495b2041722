"""Licence scans: units of a text against licence templates by the Dice coefficient of their word bigrams.

Units are the lines of a text, its paragraphs of several lines, runs of neighbouring paragraphs, runs of neighbouring
sentences, and the whole text where it has several paragraphs. Dice can reach t only if the sizes lie within t / (2 - t)
of each other, so a unit outside the bounds of every template is dropped before its bigrams are made, and a template
outside the unit's bounds before it is compared. From the same bound, a unit holds at least the share t / (2 - t) of a
template's bigrams; a few key words that touch more than the rest of them in every template therefore occur in every
unit that can match, and units without one are not split into words at all. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed, let

DICE = 0.8
SPAN = 4
#: Words that hardly tell texts apart; they become key words only where nothing else is left.
_FREQUENT = frozenset("a and any as at be by for from in is it its may no not of on or that the this to under with you".split())
_OTHER = "[^\\p{L}\\p{N}]+"


@dataclass(frozen=True)
class Template:
    licence: str
    text: str


# Notices as their licences ask for them, with the spelling found most often.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""
_GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version."""
_GPL2_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License version 2 as published by the Free Software Foundation."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""
_LGPL = """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""
_LGPL21 = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version."""
_BSD3 = _BSD2 + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEMPLATES = [Template(*x) for x in (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD3),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD2),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("GPL-3.0", _GPL),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL2),
    ("GPL-2.0", _GPL2_ONLY),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _LGPL),
    ("LGPL-2.1", _LGPL21),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _AGPL),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _OTHER), lambda w: w != "")


def _bigrams(text: str) -> list[str]:
    """The same of a template, as a set."""
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def key_words(grams: list[list[str]], dice: float) -> list[str]:
    """Words of which every unit that reaches ``dice`` with one of the templates holds at least one.

    A unit may lack n - need of a template's n bigrams; words are added, long ones and those of many templates first,
    until in every template more bigrams than that hold one of them.
    """
    bags = [set(b) for b in grams]
    lack = [len(b) - bounds(len(b), dice)[0] + 1 for b in bags]
    chosen: list[str] = []
    while any(n > 0 for n in lack):
        gain: dict[str, int] = {}
        for b, n in zip(bags, lack):
            if n > 0:
                for g in b:
                    for w in set(g.split(" ")):
                        gain[w] = gain.get(w, 0) + 1
        best = min(gain, key=lambda w: (w in _FREQUENT, -gain[w] * len(w) ** 2, w))
        chosen.append(best)
        for i, b in enumerate(bags):
            rest = {g for g in b if best not in g.split(" ")}
            lack[i] -= len(b) - len(rest)
            bags[i] = rest
    return chosen


def _unit_bigrams(text: Column, smallest: int, largest: int, keys: str) -> Column:
    """Distinct bigrams of a unit, or none where it holds no key word or their number is certain to be out of bounds.

    A unit of n bigrams has at least 2 n + 1 characters, and no fewer bigrams than distinct words less one.
    """
    def pairs(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)),
                                           lambda a, b: F.concat(a, F.lit(" "), b)))

    fits = lambda w: (F.size(w) > smallest) & (F.size(F.array_distinct(w)) <= largest + 1)
    made = let(words(text), lambda w: F.when(fits(w), pairs(w)))
    return F.when((F.char_length(text) > 2 * smallest) & F.lower(text).rlike(keys), made)


def _units(docs: DataFrame, smallest: int, largest: int, keys: str, span: int) -> DataFrame:
    """doc_id, unit, part (number of the unit's first piece), span (its pieces), b (bigrams) of units that can match."""
    text = F.col("text")

    def made(sort: str, t: Column, i: Column, n: Column) -> Column:
        return F.struct(F.lit(sort).alias("unit"), i.cast("int").alias("part"), n.cast("int").alias("span"),
                        _unit_bigrams(t, smallest, largest, keys).alias("b"))

    def unit(sort: str) -> Callable[[Column, Column], Column]:
        return lambda t, i: made(sort, t, i, F.lit(1))

    def runs(pieces: Column, sort: str, least: int) -> Column:
        """Runs of ``least`` to ``span`` neighbouring pieces."""
        def of(n: int) -> Column:
            starts = F.when(F.size(pieces) >= n, F.sequence(F.lit(1), F.size(pieces) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: made(sort, F.array_join(F.slice(pieces, i, F.lit(n)), "\n"), i - 1, F.lit(n)))
        return F.concat(*[of(n) for n in range(least, span + 1)])

    nothing = F.lit("")
    lines = F.transform(F.split(text, "\n"), unit("line"))
    blocks = F.split(text, "\n[ \t\r]*\n")
    # a paragraph of one line, and a text of one paragraph, are no units of their own
    paragraphs = F.transform(blocks, lambda p: F.when(F.contains(p, F.lit("\n")), p).otherwise(nothing))
    paragraphs = F.transform(paragraphs, unit("paragraph"))
    whole = F.transform(F.array(F.when(text.rlike("\n[ \t\r]*\n"), text).otherwise(nothing)), unit("text"))
    sentences = F.split(F.regexp_replace(text, "([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")
    every = F.concat(lines, paragraphs, whole, let(blocks, lambda b: runs(b, "paragraphs", 2)),
                     let(F.when(F.size(sentences) > 1, sentences).otherwise(F.array().cast("array<string>")), lambda s: runs(s, "sentences", 1)))
    fitting = F.filter(every, lambda u: F.coalesce(F.size(u["b"]), F.lit(0)).between(smallest, largest))
    some = docs.where(F.lower(text).rlike(keys))
    return some.select("doc_id", F.explode(fitting).alias("u")).select("doc_id", "u.unit", "u.part", "u.span", "u.b")


def bounds(n: int, dice: float) -> tuple[int, int]:
    """Least and greatest number of bigrams of a unit that can reach ``dice`` with a template of ``n``."""
    return max(1, math.ceil(n * dice / (2 - dice) - 1e-9)), math.floor(n * (2 - dice) / dice + 1e-9)


def scan(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, dice: float = DICE, doc_id: str = "doc_id",
         text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, unit, part, span, licence, dice: the best template of every unit that reaches ``dice`` with one.

    Sorts of units are line, paragraph (of several lines), text (of several paragraphs), and runs of up to ``span``
    pieces: paragraphs (from two on) and sentences (of a text with several), which end at ``.``, ``!`` or ``?`` before white
    space. Runs that overlap are reported each. Bigrams are sets of neighbouring words. Ties go to the licence first by name. Null and empty texts and units of one
    word match nothing; repeated rows are reported as often as they occur. Units with the same licence in one document
    are reported each.
    """
    grams = [(t.licence, b) for t in templates if (b := _bigrams(t.text))]
    src = keyed(docs, doc_id, text).toDF("doc_id", "text")
    if not grams:
        return src.select("doc_id", F.lit("").alias("unit"), F.lit(0).alias("part"), F.lit(0).alias("span"),
                          F.lit("").alias("licence"), F.lit(0.0).alias("dice")).where("false")
    sizes = [bounds(len(b), dice) for _, b in grams]
    keys = "(?<![\\p{L}\\p{N}])(?:" + "|".join(key_words([b for _, b in grams], dice)) + ")(?![\\p{L}\\p{N}])"
    units = _units(src, min(a for a, _ in sizes), max(b for _, b in sizes), keys, span)
    every = F.array(*map(F.lit, sorted({g for _, b in grams for g in b})))
    near = units.withColumn("hit", F.array_intersect("b", every)).where(F.size("hit") > 0)
    n = F.size("b")
    scores = []
    for (licence, b), (least, most) in zip(grams, sizes):
        common = F.size(F.array_intersect("hit", F.array(*map(F.lit, b))))
        value = F.when(n.between(least, most), 2.0 * common / (n + len(b))).otherwise(F.lit(0.0))
        scores.append(F.struct((-value).alias("d"), F.lit(licence).alias("licence")))
    best = near.withColumn("best", F.array_min(F.array(*scores)))
    return best.where(F.col("best.d") <= -dice + 1e-12).select(
        "doc_id", "unit", "part", "span", F.col("best.licence").alias("licence"), (-F.col("best.d")).alias("dice"))
