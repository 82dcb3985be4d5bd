"""License scans: passages of normalised text against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.llm.common import arrow_map
from scatterwave.runtime import ship

SIMILARITY = 0.8
#: Statements and notices as licences and their stewards publish them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated software packages",
    ),
    "LGPL-2.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ),
    "EPL-1.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
}
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    licence: str
    size: int  # words
    bigrams: Counter
    anchors: frozenset  # a passage that is similar enough has one of these


def _apart(passages: list[tuple]) -> list[tuple]:
    """Those of ``(dice, first, end, ...)`` that overlap none before them."""
    firsts, ends, out = [], [], []
    for m in passages:
        k = bisect_left(firsts, m[2])  # the last taken one that begins before this one's end
        if k == 0 or ends[k - 1] <= m[1]:
            firsts.insert(k, m[1])
            ends.insert(k, m[2])
            out.append(m)
    return out


class Matcher:
    """Templates with their size bounds and the bigrams of which any match must hold one."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, similarity: float = SIMILARITY):
        self.similarity, self.templates = similarity, []
        words = {(name, t): normalise(t) for name, ts in templates.items() for t in ts}
        often = Counter(b for w in words.values() for b in set(zip(w, w[1:])))
        for (name, _), w in words.items():
            grams = Counter(zip(w, w[1:]))
            # A passage of n bigrams with Dice >= s shares at least s (n + m) / 2 >= s m / (2 - s) of m.
            need = max(1, -(-int(similarity * 1000) * len(w[1:]) // int((2 - similarity) * 1000)))
            free, anchors = len(w[1:]) - need + 1, []
            for g in sorted(grams, key=lambda g: (often[g], g)):
                if free <= 0:
                    break
                anchors.append(g)
                free -= grams[g]
            self.templates.append(Template(name, len(w), grams, frozenset(anchors)))
        self.anchors = frozenset().union(*[t.anchors for t in self.templates])
        self.bigrams = frozenset().union(*[t.bigrams for t in self.templates])

    def passages(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """``licence, first word, end word, dice``: passages of every size that reach the similarity, not overlapping.

        Of each template, the best by Dice are taken first, and of those of all templates the ones that share the most
        bigrams; ties go to the earlier passage. A passage of size bigrams can reach s only if s / (2 - s) n <= size <=
        (2 - s) / s n, and one whose first or last bigram is none of the template's is less similar than without it, so
        passages begin and end with a template's bigram.
        """
        words = normalise(text or "")
        pairs = list(zip(words, words[1:]))
        if self.anchors.isdisjoint(pairs):
            return []
        where: dict = {}
        for i, p in enumerate(pairs):
            if p in self.bigrams:
                where.setdefault(p, []).append(i)
        found = []
        for t in self.templates:
            if t.anchors.isdisjoint(where):
                continue
            n, s = t.size - 1, self.similarity
            at = sorted(i for g in t.bigrams for i in where.get(g, ()))
            longest = int((2 - s) / s * n + 1e-9)
            least = -(-int(s * 1000) * n // int((2 - s) * 1000))  # bigrams that any match shares
            own = []
            for a in range(len(at) - least + 1):
                if at[a + least - 1] - at[a] >= longest:
                    continue
                first, left, shared = at[a], dict(t.bigrams), 0
                for i in at[a:]:
                    size = i - first + 1
                    if size > longest:
                        break
                    if left[pairs[i]] > 0:
                        left[pairs[i]] -= 1
                        shared += 1
                        dice = 2 * shared / (n + size)
                        if dice >= s:
                            own.append((-dice, first, first + size + 1, t.licence, shared))
            found += _apart(sorted(own))
        best = _apart(sorted(found, key=lambda m: (-m[4], *m)))
        return sorted(((name, a, b, -dice) for dice, a, b, name, _ in best), key=lambda m: m[1])


@lru_cache(maxsize=1)
def default_matcher() -> Matcher:
    return Matcher()


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licence, first_word, end_word, dice``: one row per passage found in a whole text.

    Null, empty and unlicensed texts give no rows, nor does an empty table; repeated rows give theirs each. Whole texts
    of any length are looked at. Only doc_id and text are read, so other columns may have any names.
    """
    ship(docs.sparkSession)

    def run(batch):
        matcher = default_matcher()
        rows = [(i, *m) for i, text in zip(batch["doc_id"], batch["text"]) for m in matcher.passages(text)]
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "licence": pa.string(), "first_word": pa.int64(), "end_word": pa.int64(), "dice": pa.float64()}
        return {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, licence string, first_word long, end_word long, dice double")
