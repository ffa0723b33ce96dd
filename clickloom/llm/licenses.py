"""License notices in texts, found by MinHash bands over overlapping windows and verified by exact containment.

Everything runs as DataFrame functions. A template of at most 2^c words is looked for in windows of 1.5 * 2^c words, of
which one starts every 2^(c-1) words, so some window holds any whole notice. A window and a template that it contains have
a Jaccard similarity of at least 0.125 (worst case: one shingle in a window of the smallest class), and BANDS bands of one
value each miss that with a probability below 0.0002. Retrieved pairs are verified by the exact share of the template's
shingles in the window; windows without any shingle of any template are left out before. Notices of fewer words than a
shingle are found by their whole sequence of words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.75
BANDS = 64
SMALLEST = 3
WORD = r"[\p{L}\p{N}]+"

# License notices as their authors word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "Copyright. All rights reserved. No part may be reproduced without permission.",
}
# Notices of fewer than SHINGLE words, which documents carry as a line of their own.
SHORT = {"all-rights-reserved-line": "All rights reserved."}


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def size(self) -> int:
        """Class c: the template has at most 2^c words."""
        return max(SMALLEST, (len(self.words) - 1).bit_length())

    @property
    def shingles(self) -> set[tuple[str, ...]]:
        return {self.words[i : i + SHINGLE] for i in range(len(self.words) - SHINGLE + 1)}


def templates(texts: dict[str, str] | None = None) -> list[Template]:
    """Templates by name; each has a word at least."""
    out = []
    for name, text in sorted((TEMPLATES if texts is None else texts).items()):
        found = tuple(w for w in re.findall(r"[^\W_]+", text.lower()))
        if not found:
            raise ValueError(f"template {name} has no word")
        out.append(Template(name, found))
    return out


def cues(found: list[Template]) -> list[tuple[str, str]]:
    """Neighbouring words of which every shingle of every template has at least one pair, long ones first.

    Single words would not do: some shingles consist of common ones.
    """
    left = {s for t in found for s in t.shingles}
    out = []
    while left:
        count: dict[tuple[str, str], int] = {}
        for s in left:
            for pair in set(zip(s, s[1:])):
                count[pair] = count.get(pair, 0) + 1
        best = max(count, key=lambda p: (count[p] * len(p[0] + p[1]) ** 2, p))
        out.append(best)
        left = {s for s in left if best not in zip(s, s[1:])}
    return sorted(out)


def _hashes(words: Column) -> Column:
    """Hash of each 5-word shingle, by position."""
    at = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.when(F.size(words) >= SHINGLE, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))).otherwise(
        F.expr("CAST(array() AS array<bigint>)")
    )


def _signature(hashes: Column) -> Column:
    """For each band the least hash under its own order: the hashes mixed anew with the band's number.

    Flipping bits alone would not do: which hash is least then hangs on the leading bits of its neighbours.
    """
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def _reference(spark: SparkSession, found: list[Template]) -> DataFrame:
    rows = [(t.name, t.size, list(t.words)) for t in found]
    table = spark.createDataFrame(rows, "license string, size int, words array<string>")
    return table.select("license", "size", F.array_distinct(_hashes(F.col("words"))).alias("wanted"))


def _pattern(sequences: list[tuple[str, ...]]) -> str:
    """Pattern of any of some sequences of whole words."""
    return r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])" % "|".join(r"[^\p{L}\p{N}]+".join(s) for s in sequences)


def _words(lower: DataFrame, sequences: list[tuple[str, ...]]) -> DataFrame:
    """Words of the texts that have any of some sequences of words."""
    hit = lower.where(F.col("lower").rlike(_pattern(sequences)))
    return hit.select("id", F.regexp_extract_all("lower", F.lit(WORD), F.lit(0)).alias("words"))


def _place(words: Column, wanted: tuple[str, ...]) -> Column:
    """Place of the first occurrence of a sequence of words, from 1; 0 or null without one."""
    n = len(wanted)
    parts = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, F.lit(n)))
    return F.when(F.size(words) >= n, F.array_position(parts, F.array(*map(F.lit, wanted))))


def _short(lower: DataFrame, found: list[Template]) -> DataFrame:
    """(id, license, first, share) of the templates of fewer than SHINGLE words, found whole."""
    # A text without the templates' longest words needs no pattern.
    longest = {max(t.words, key=len) for t in found}
    some = lower.where(reduce(or_, [F.col("lower").contains(w) for w in sorted(longest)]))
    places = [F.struct(F.lit(t.name).alias("license"), _place(F.col("words"), t.words).alias("place")) for t in found]
    met = _words(some, [t.words for t in found]).select("id", F.explode(F.array(*places)).alias("met"))
    return met.where("met.place > 0").select("id", "met.license", (F.col("met.place") - 1).cast("int").alias("first"), F.lit(1.0).alias("share"))


def _windows(words: DataFrame, reference: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, size, first, hashes) of the windows that have a shingle of a template; the others have no share of any."""
    hashed = words.select("id", F.explode(F.array(_hashes(F.col("words")))).alias("all")).where(F.size("all") > 0)
    wanted = [r["h"] for r in reference.select(F.explode("wanted").alias("h")).distinct().collect()]
    places = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).isin(wanted))
    hashed = hashed.select("id", "all", F.explode(F.array(places)).alias("places")).where(F.size("places") > 0)
    starts = [F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(1 << (c - 1))), _window(c)) for c in sizes]
    windows = hashed.select("id", "all", "places", F.explode(F.flatten(F.array(*starts))).alias("w"))
    inside = F.exists("places", lambda i: (i >= F.col("w.first")) & (i < F.col("w.first") + F.col("w.length")))
    hashes = F.slice("all", F.col("w.first") + 1, F.col("w.length"))
    return windows.where(inside).select("id", "w.size", "w.first", hashes.alias("hashes"))


def _long(lower: DataFrame, found: list[Template]) -> DataFrame:
    """(id, license, first, share) of the windows that hold CONTAINED or more of a template's shingles."""
    reference = _reference(lower.sparkSession, found)
    # A text without any cue has no shingle of any template.
    words = _words(lower, cues(found))
    windows = _windows(words, reference, sorted({t.size for t in found}))
    bands = windows.select("id", "size", "first", "hashes", F.posexplode(_signature(F.col("hashes"))).alias("band", "value"))
    known = reference.select("license", "size", "wanted", F.posexplode(_signature(F.col("wanted"))).alias("band", "value"))
    met = bands.join(F.broadcast(known), ["size", "band", "value"])
    share = F.size(F.array_intersect("hashes", "wanted")) / F.size("wanted")
    return met.select("id", "license", "first", share.alias("share")).where(F.col("share") >= CONTAINED)


def scan(
    docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, license, containment (best window's share of the template's shingles) and first_word (of the first such window).

    One row for each id and template of which some window holds CONTAINED or more. Words are runs of letters and digits in
    lower case. Of a template with fewer than SHINGLE words the window is the occurrence itself, which has all its words in
    order. Null and empty texts give no row; texts are read whole at any length; rows with the same id are one document;
    other columns are ignored. The templates (TEMPLATES unless given) are a bounded list, broadcast.
    """
    found = templates(texts)
    lower = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("lower"))
    long, short = [t for t in found if len(t.words) >= SHINGLE], [t for t in found if len(t.words) < SHINGLE]
    parts = [run(lower, some) for run, some in ((_long, long), (_short, short)) if some]
    verified = reduce(DataFrame.unionByName, parts)
    out = verified.groupBy("id", "license").agg(F.max("share").alias("containment"), F.min("first").cast("long").alias("first_word"))
    return out.withColumnRenamed("id", id_col)


def _window(c: int):
    length = (1 << c) + (1 << (c - 1)) - SHINGLE + 1
    return lambda s: F.struct(F.lit(c).alias("size"), s.cast("int").alias("first"), F.lit(length).alias("length"))
