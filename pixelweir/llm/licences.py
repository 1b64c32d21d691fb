"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Texts and templates become lower-case words without punctuation. An index from bigram to template finds where a
template's bigrams stand; a passage can only reach the threshold if its size is within bounds that follow from the
template's size, and if enough of its bigrams are there. Passages may stand anywhere in a text. Where passages of
several templates overlap, the one counts whose common bigrams outnumber those that only one side has by most, so that
a text of three clauses isn't taken for its first two; then the one with the better score.

Templates are one-line notices of all licences in NAMES, the whole texts of short licences, and the headers and first
paragraphs of long ones (Apache, GNU, Mozilla, Creative Commons), whose later sections are no templates.

Results: null and empty texts have none. Repeated rows are scanned alike. Other columns are left out.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import bound_batches, read, slices, tidy
from pixelweir.llm.rolling import gram_hashes, word_hashes

LEAST = 0.8

# Licence names as notices write them, by SPDX identifier.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "ISC": ("ISC License",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
}
OPENINGS = (
    "Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under the", "Available under the", "This work is licensed under", "This work is licensed under the",
    "This project is licensed under the", "This software is licensed under the", "SPDX-License-Identifier:",
)
# Texts of licences, in their own words.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
    THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
    OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
    ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
    THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
    publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
    purpose, commercial or non-commercial, and by any means."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
    published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
    version."""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_GNU_TOP = """GNU {name} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted
    to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
#: (licence, name, version, date, years) of the GNU licences.
_GNU_KINDS = (
    ("GPL-2.0", "General Public License", "2", "June 1991", "1989, 1991"),
    ("GPL-3.0", "General Public License", "3", "29 June 2007", "2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007", "2007"),
    ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007", "2007"),
)
TEXTS = [
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_END}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    *[(k, _GNU.format(name=name, version=v)) for k, name, v, _, _ in _GNU_KINDS],
    *[(k, f"{_GNU} {_GNU_END}".format(name=name, version=v)) for k, name, v, _, _ in _GNU_KINDS],
    *[(k, _GNU_TOP.format(name=name, version=v, date=date, years=years)) for k, name, v, date, years in _GNU_KINDS],
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    (
        "CC0-1.0",
        """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his
        or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent
        allowed by law. You can copy, modify, distribute and perform the work, even for commercial purposes, all without
        asking permission.""",
    ),
    *[
        (f"CC-{kind}-4.0", f"Creative Commons {name} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License")
        for kind, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ],
    ("Unlicense", _UNLICENSE),
    (
        "Unlicense",
        f"""{_UNLICENSE} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
]


def templates() -> list[tuple[str, str]]:
    """(licence, text): notices are openings with each name, besides the texts."""
    return [(k, f"{o} {n}") for k, names in NAMES.items() for n in names for o in OPENINGS] + TEXTS + [("proprietary", "All rights reserved.")]


class Index:
    """Bigrams of the templates."""

    def __init__(self, rows: list[tuple[str, str]], least: float):
        self.least = least
        grams = [gram_hashes(word_hashes([t.encode()])[0], 2) for _, t in rows]
        kept = [i for i, g in enumerate(grams) if len(g)]
        self.names = [rows[i][0] for i in kept]
        self.bags = [Counter(grams[i].tolist()) for i in kept]
        self.sizes = [len(grams[i]) for i in kept]
        # Dice >= least needs size >= least / (2 - least) of the template's, and no more than its inverse
        self.low = [math.ceil(n * least / (2 - least) - 1e-9) for n in self.sizes]
        self.high = [math.floor(n * (2 - least) / least + 1e-9) for n in self.sizes]
        self.need = [math.ceil(least * (n + low) / 2 - 1e-9) for n, low in zip(self.sizes, self.low, strict=True)]
        owners: dict[int, list[int]] = {}
        for i, bag in enumerate(self.bags):
            for g in bag:
                owners.setdefault(g, []).append(i)
        self.grams = np.array(sorted(owners), np.uint64)
        self.owners = [owners[g] for g in self.grams.tolist()]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, str, float, int, int]]:
        """(text, licence, score, first byte, end byte) of each passage."""
        words, number, begin, end = word_hashes(texts)
        grams = gram_hashes(words, 2)
        at = np.flatnonzero(self.filter[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[number[at] == number[at + 1]] if len(at) else at
        k = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[k] == grams[at] if len(at) else np.zeros(0, bool)
        at, k = at[same].tolist(), k[same].tolist()
        for t, passages in sorted(self._passages(at, k, grams, number).items()):
            starts: list[int] = []  # of the passages that count, which don't overlap, and their ends
            ends: list[int] = []
            # (1.5 * score - 1) * sizes is the number of common bigrams less those that only one side has
            worth = lambda x: round((1.5 * x[0] - 1) * (self.sizes[x[3]] + x[2] - x[1] + 1))
            for score, a, b, i in sorted(passages, key=lambda x: (-worth(x), -x[0], x[1], self.names[x[3]])):
                p = bisect(starts, b)
                if p == 0 or ends[p - 1] < a:
                    starts.insert(p, a)
                    ends.insert(p, b)
                    yield t, self.names[i], score, int(begin[a]), int(end[b + 1])

    def _passages(self, at: list[int], k: list[int], grams: np.ndarray, number: np.ndarray) -> dict[int, list[tuple[float, int, int, int]]]:
        """All passages over the threshold by text: (score, first and last bigram place, template), the best of each template from each place on."""
        places: dict[tuple[int, int], list[int]] = {}
        for p, g in zip(at, k, strict=True):
            for i in self.owners[g]:
                places.setdefault((int(number[p]), i), []).append(p)
        found: dict[int, list[tuple[float, int, int, int]]] = {}
        for (t, i), at_ in places.items():
            need = self.need[i]
            for j in range(len(at_) - need + 1):
                if at_[j + need - 1] - at_[j] < self.high[i]:
                    best = self._best(i, at_, j, grams)
                    if best:
                        found.setdefault(t, []).append((best[0], at_[j], best[1], i))
        return found

    def _best(self, i: int, at: list[int], j: int, grams: np.ndarray) -> tuple[float, int] | None:
        """The best passage from bigram place at[j] on: its score and last bigram place."""
        left, common, best = dict(self.bags[i]), 0, None
        for p in at[j:]:
            size = p - at[j] + 1
            if size > self.high[i]:
                break
            g = int(grams[p])
            if left.get(g, 0):
                left[g] -= 1
                common += 1
            score = 2 * common / (self.sizes[i] + size)
            if size >= self.low[i] and score >= self.least - 1e-12 and (best is None or score > best[0]):
                best = (score, p)
        return best


@cache
def _index(least: float) -> Index:
    return Index(templates(), least)


def scan(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, score, b, e): a row for each licence passage, with its byte span in the text's UTF-8."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(least)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                ids = b.column("doc_id").to_pylist()
                rows = list(index.scan([(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                    ["doc_id", "licence", "score", "b", "e"],
                )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, licence string, score double, b long, e long")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
