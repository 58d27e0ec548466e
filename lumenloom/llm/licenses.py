"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Units are the lines and paragraphs of a text, the text itself, and windows of its words. A unit is
compared only with templates that share a bigram with it and whose size lets the coefficient reach
the threshold: 2 min(a, b) / (a + b) bounds it, so sizes outside [t / (2 - t), (2 - t) / t] times a
template's are skipped. Bigrams count with their multiplicity. Windows have every size within these
bounds and slide over the whole text; cutting a bigram at an end that isn't shared only raises the
coefficient, so they start and end with shared ones. Of overlapping windows of one template the
best stays, of several templates the one that shares the most bigrams; a window within a line,
paragraph or text that matched the same template is not told again.

Defined cases: null, empty and word-free texts match nothing; of equal coefficients the first
template in the order of ids wins; repeated documents are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of public licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: The conditions above with the disclaimers that complete files add.
TEMPLATES |= {
    "bsd-2-clause-text": TEMPLATES["bsd-2-clause"] + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc-text": TEMPLATES["isc"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-text": TEMPLATES["mit"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}

#: Further notices and short licences.
TEMPLATES |= {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause-text": TEMPLATES["bsd-2-clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + TEMPLATES["bsd-2-clause-text"].removeprefix(TEMPLATES["bsd-2-clause"]),
    "bsl-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def _apart(ranked: list[tuple]) -> list[tuple]:
    """Of windows (.., .., first, last, ..) each that overlaps none before it."""
    kept: list[tuple] = []
    starts: list[int] = []
    for w in ranked:
        k = bisect(starts, w[2])
        if (k == 0 or kept[k - 1][3] < w[2]) and (k == len(kept) or w[3] < kept[k][2]):
            kept.insert(k, w)
            starts.insert(k, w[2])
    return kept


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = {name: bigrams(text) for name, text in sorted(templates.items())}
        self.sizes = {name: b.total() for name, b in self.templates.items()}
        reach = threshold / (2 - threshold)
        self.bounds = {name: (n * reach - 1e-9, n / reach + 1e-9) for name, n in self.sizes.items()}
        self.least = min((lo for lo, _ in self.bounds.values()), default=1)
        self.most = max((hi for _, hi in self.bounds.values()), default=0)
        self.by_bigram: dict[tuple[str, str], list[str]] = {}
        for name, found in self.templates.items():
            for pair in found:
                self.by_bigram.setdefault(pair, []).append(name)
        self.firsts = {pair[0] for pair in self.by_bigram}

    def unit(self, words: list[str]) -> tuple[str, float] | None:
        """The best template of one unit at or above the threshold."""
        size = len(words) - 1
        if not self.least <= size <= self.most or self.firsts.isdisjoint(words):
            return None
        pairs = Counter(zip(words, words[1:]))
        near = {name for pair in pairs.keys() & self.by_bigram.keys() for name in self.by_bigram[pair]}
        best = None
        for name in sorted(near):
            low, high = self.bounds[name]
            if low <= size <= high and (value := dice(pairs, self.templates[name])) >= self.threshold and (best is None or value > best[1]):
                best = (name, value)
        return best

    def _slide(self, name: str, at: list[int], pairs: list[tuple[str, str]]) -> list[tuple[float, int, int, int]]:
        """(coefficient, shared, first, last bigram) of the best windows of a template, none overlapping;
        at: places of its bigrams."""
        n, wanted = self.sizes[name], self.templates[name]
        low, high = self.bounds[name]
        need, high = max(1, math.ceil(low - 1e-9)), high + 1e-9
        found = []
        for k in range(len(at) - need + 1):
            first = at[k]
            if at[k + need - 1] - first >= high:
                continue
            left, shared, best = {}, 0, None
            for last in at[k:]:
                size = last - first + 1
                if size > high:
                    break
                pair = pairs[last]
                more = left.get(pair, wanted[pair])
                if more:
                    left[pair] = more - 1
                    shared += 1
                    value = 2 * shared / (size + n)
                    if value >= self.threshold and (best is None or value > best[0]):
                        best = (value, shared, first, last)
            if best:
                found.append(best)
        return _apart(sorted(found, key=lambda w: (-w[0], -w[1], w[2])))

    def windows(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first, last word) of every window that matches."""
        if self.firsts.isdisjoint(words):
            return []
        pairs = list(zip(words, words[1:]))
        places: dict[str, list[int]] = {}
        for k, pair in enumerate(pairs):
            if pair in self.by_bigram:
                for name in self.by_bigram[pair]:
                    places.setdefault(name, []).append(k)
        found = [(*w, name) for name, at in sorted(places.items()) for w in self._slide(name, at, pairs)]
        kept = _apart(sorted(found, key=lambda w: (-w[1], -w[0], w[2], w[4])))
        return [(name, value, first, last + 1) for value, _, first, last, name in sorted(kept, key=lambda w: w[2])]

    def scan(self, text: str | None, windows: bool = False) -> list[tuple[str, float, str]]:
        """(template, coefficient, unit) of every unit that matches; units are 'line 3', 'words 5-9' and so on."""
        if not text:
            return []
        lines = [_WORD.findall(line) for line in text.lower().split("\n")]
        everything = [w for words in lines for w in words]
        found, told, start = [], [], 0
        for n, words in enumerate(lines, 1):
            if hit := self.unit(words):
                found.append((*hit, f"line {n}"))
                told.append((hit[0], start, start + len(words)))
            start += len(words)
        if len(lines) > 1:
            if hit := self.unit(everything):
                found.append((*hit, "text"))
                told.append((hit[0], 0, len(everything)))
            if len(paragraphs := _PARAGRAPH.split(text.lower())) > 1:
                start = 0
                for n, paragraph in enumerate(paragraphs, 1):
                    words = _WORD.findall(paragraph)
                    if "\n" in paragraph and (hit := self.unit(words)):
                        found.append((*hit, f"paragraph {n}"))
                        told.append((hit[0], start, start + len(words)))
                    start += len(words)
        for name, value, first, last in self.windows(everything) if windows else ():
            if not any(name == t and low <= first and last < high for t, low, high in told):
                found.append((name, value, f"words {first + 1}-{last + 1}"))
        return found


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8, windows: bool = False) -> DataFrame:
    """One row per document: doc_id, n_matches, license (the best), dice, matches (all).
    windows: notices beside other words count too, not just those that fill a line, paragraph or text."""
    given = TEMPLATES if templates is None else templates

    @F.pandas_udf("array<struct<license:string,dice:double,unit:string>>")
    def each(texts: pd.Series) -> pd.Series:
        scanner = Scanner(given, threshold)
        return pd.Series([[{"license": n, "dice": d, "unit": u} for n, d, u in scanner.scan(t, windows)] for t in texts])

    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), each(F.col(f"`{text}`")).alias("matches"))
    ranked = F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("minus"), m["license"].alias("license"))))
    best = F.get(ranked, F.lit(0))
    return rows.select(doc_id, F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), (-best["minus"]).alias("dice"), "matches")
