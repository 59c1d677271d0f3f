"""License scans in DataFrame functions: MinHash bands over text windows retrieve templates, exact containment verifies."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, the containment that makes a match, and the bands (of one row each).
WORDS, CONTAINED, BANDS = 5, 0.8, 24

# Notices of common licenses, as they are published (name, notice).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


class Template(NamedTuple):
    """Distinct shingles of a notice, those a match needs, and the windows in which it is looked for."""

    name: str
    number: int
    shingles: tuple[str, ...]
    need: int
    window: int
    step: int

    @property
    def miss(self) -> float:
        """Probability at most that no band of a window with ``need`` of the shingles collides."""
        jaccard = self.need / (self.window + len(self.shingles) - self.need)
        return (1 - jaccard) ** BANDS


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def templates(notices: tuple[tuple[str, str], ...] = NOTICES) -> list[Template]:
    """Windows hold twice a template's shingles and advance by half of them: a stretch of 1.5 times its length lies in one."""
    out = []
    for i, (name, notice) in enumerate(notices):
        w = words_of(notice)
        if len(w) < WORDS:
            raise ValueError(f"a notice needs {WORDS} words: {notice}")
        s = tuple(dict.fromkeys(" ".join(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)))
        out.append(Template(name, i, s, math.ceil(CONTAINED * len(s)), 2 * len(s), max(1, len(s) // 2)))
    return out


def needed_words(found: list[Template]) -> list[str]:
    """Words of which every match of any template holds one: fewer shingles than a match needs are without them."""
    chosen: list[str] = []
    for t in found:
        left = [set(s.split()) for s in t.shingles]
        left = [s for s in left if not s & set(chosen)]
        while len(left) >= t.need:
            best = max(sorted({w for s in left for w in s}), key=lambda w: (len(w) >= 6, sum(w in s for s in left), len(w)))
            chosen.append(best)
            left = [s for s in left if best not in s]
    return chosen


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame, text_col: str = "text", out: str = "licenses", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Add ``out``: array of structs (license, notice, at, contained), one for each window with a verified match.

    A window matches a notice if it holds at least CONTAINED of its distinct 5-word shingles (words: runs of
    ASCII letters and digits, in lower case); ``at`` is the window's first word, ``contained`` the share. A
    window is verified if one of BANDS min-hashes equals the notice's: a match has at least a Jaccard
    similarity of need / (2 s + s - need) with a notice of s shingles, so it is missed with a probability of
    at most (1 - that) ** BANDS, below 0.0001. A notice is looked for only in texts that hold one of the words of
    which every match of it needs one. Null and short texts give an empty array, an empty table an empty one; a column named
    ``out`` is replaced, others stay. Row-wise, repeated rows as well, over whole texts: no shuffle.
    """
    known = templates(notices)
    first = docs[text_col].cast("string")
    holds = lambda text, of: text.rlike("(?<![a-z0-9])(?:" + "|".join(needed_words(of)) + ")(?![a-z0-9])")
    may = F.coalesce(holds(F.lower(first), known), F.lit(False))
    hashes = lambda s, i: F.xxhash64(s, F.lit(i))

    def shingles(words: Column) -> Column:
        return F.when(F.size(words) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.array_join(F.slice(words, i, WORDS), " ")))

    def windows(s: Column) -> Column:
        minima = F.array(*[F.transform(s, lambda x: hashes(x, i)) for i in range(BANDS)])

        def of(x: Column) -> Column:
            parts = []
            for t in known:
                mine = F.array(*[F.array_min(F.array(*[hashes(F.lit(y), i) for y in t.shingles])) for i in range(BANDS)])
                own = F.array(*[F.lit(y) for y in t.shingles])

                def match(at: Column) -> Column:
                    share = F.size(F.array_intersect(F.slice(x.s, at + 1, t.window), own)) / F.lit(float(len(t.shingles)))
                    return F.struct(F.lit(t.name).alias("license"), F.lit(t.number).alias("notice"), at.alias("at"), share.alias("contained"))

                def banded(at: Column) -> Column:
                    return F.arrays_overlap(F.transform(x.m, lambda column: F.array_min(F.slice(column, at + 1, t.window))), mine)

                places = F.when(F.get(x.may, t.number), F.sequence(F.lit(0), F.size(x.s) - 1, F.lit(t.step))).otherwise(F.array().cast("array<int>"))
                parts.append(F.filter(F.transform(F.filter(places, banded), match), lambda y: y.contained >= CONTAINED - 1e-9))
            return F.concat(*parts)

        return let(F.struct(s.alias("s"), minima.alias("m"), F.array(*[holds(F.lower(first), [t]) for t in known]).alias("may")), of)

    words = F.regexp_extract_all(F.lower(first), F.lit("[a-z0-9]+"), F.lit(0))
    found = F.when(may, let(words, lambda w: let(shingles(w), lambda s: F.when(s.isNotNull(), windows(s)))))
    return docs.withColumn(out, F.coalesce(found, F.array().cast("array<struct<license:string,notice:int,at:int,contained:double>>")))
