"""Licence scans: stretches of normalised text compared to licence templates by the Dice coefficient of word bigrams.

A stretch of w bigrams can reach a Dice coefficient t with a template of b bigrams only if b t / (2 - t) <= w <=
b (2 - t) / t, and only if it holds at least t (w + b) / 2 of the template's bigrams. Both bounds prune templates and
stretches before any coefficient is computed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import by_batches, texts_of

WORD = re.compile(r"[a-z0-9]+")

#: Public licence texts and notices, one template each.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL": ("General Public License", "program", ("1", "2", "3")), "LGPL": ("Lesser General Public License", "library", ("2.1", "3")), "AGPL": ("Affero General Public License", "program", ("3",))}
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_AS_IS}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD_2, _BSD_2 + _BSD_AS_IS),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD_2 + _BSD_THIRD, _BSD_2 + _BSD_THIRD + _BSD_AS_IS),
    "ISC": ("Licensed under the ISC License.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_AS_IS}"),
    "0BSD": (f"{_ISC}.{_ISC_AS_IS}",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.",),
    "WTFPL": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
} | {
    f"{short}-{number}{'' if '.' in number else '.0'}": (
        f"This work is licensed under the GNU {name}, version {number}.",
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version.",
    )
    for short, (name, thing, numbers) in _GNU.items()
    for number in numbers
} | {
    f"CC-{short}-{number}": (f"Licensed under CC {short} {number}.", f"This work is licensed under a Creative Commons {name} {number} {kind} License.")
    for short, name in _CC.items()
    for number, kind in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
}


class Scanner:
    """Finds the stretches of a text that reach the coefficient with a template."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least = least
        self.names, self.grams = [], []
        words: dict[str, int] = {}
        for name, texts in templates.items():
            for t in texts:
                own = [words.setdefault(w, len(words)) for w in WORD.findall(t.lower())]
                if len(own) > 1:
                    self.names.append(name)
                    self.grams.append(list(zip(own, own[1:], strict=False)))
        self.words, self.base = words, len(words)
        code = lambda g: g[0] * self.base + g[1]
        self.counts = []
        for g in self.grams:
            own: dict[int, int] = {}
            for x in g:
                own[code(x)] = own.get(code(x), 0) + 1
            self.counts.append(own)
        self.known = np.unique(np.array([c for own in self.counts for c in own], np.int64))
        self.member = np.array([np.isin(self.known, list(own)) for own in self.counts]).reshape(len(self.counts), len(self.known))
        self.sizes = [len(g) for g in self.grams]
        self.shares = np.array([self._bounds(b)[2] for b in self.sizes])
        self.fewest = min((self._bounds(b)[2] for b in self.sizes), default=0)

    def _bounds(self, b: int) -> tuple[int, int, int]:
        """Least and most bigrams of a stretch, and the least it must share with a template of b bigrams."""
        t = self.least
        low, high = int(np.ceil(b * t / (2 - t) - 1e-9)), int(np.floor(b * (2 - t) / t + 1e-9))
        return low, high, int(np.ceil(t * (low + b) / 2 - 1e-9))

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, word after the last) of the best stretches, no two of which overlap."""
        ids = np.fromiter(map(self.words.get, WORD.findall(text.lower()), repeat(-1)), np.int64)
        if len(ids) < 2 or not self.sizes:
            return []
        both = (ids[1:] >= 0) & (ids[:-1] >= 0)
        at = np.nonzero(both)[0]
        codes = ids[at] * self.base + ids[at + 1]
        which = np.searchsorted(self.known[:-1], codes)
        keep = self.known[which] == codes
        at, codes, which = at[keep], codes[keep], which[keep]
        if len(at) < self.fewest:
            return []
        rows = {k: row for k, row in self._template_rows(at, codes, which)}
        heap = [best for k, (pos, own, starts) in rows.items() for i in starts if (best := self._best_from(k, pos, own, i))]
        heapify(heap)
        taken: list[tuple[int, int, int, float]] = []  # first word, word after, template, Dice; in order
        while heap:
            dice, _, k, i, start, end = heappop(heap)
            place = bisect_left(taken, (start,))
            if place and taken[place - 1][1] > start:
                continue
            if place < len(taken) and taken[place][0] < end:
                # What a better stretch took is gone: the best that ends before it may still do.
                if taken[place][0] > start and (shorter := self._best_from(k, *rows[k][:2], i, taken[place][0] - 2)):
                    heappush(heap, shorter)
                continue
            taken.insert(place, (start, end, k, -dice))
        return [(self.names[k], round(dice, 6), start, end) for start, end, k, dice in taken]

    def _template_rows(self, at: np.ndarray, codes: np.ndarray, which: np.ndarray):
        """For each template that may occur: (number, (places of its bigrams, their codes, places' numbers at which a stretch can begin))."""
        held = self.member @ np.bincount(which, minlength=len(self.known))  # of each template's bigrams, how many the text has
        for k in np.nonzero(held >= self.shares)[0].tolist():
            _, high, share = self._bounds(self.sizes[k])
            mine = self.member[k, which]
            pos = at[mine]
            near = np.nonzero(pos[share - 1 :] - pos[: len(pos) - share + 1] < high)[0]
            if len(near):
                yield k, (pos.tolist(), codes[mine].tolist(), near.tolist())

    def _best_from(self, k: int, pos: list[int], codes: list[int], i: int, last: int | None = None) -> tuple[float, int, int, int, int, int] | None:
        """The best stretch of template k from its i-th bigram on, up to bigram place `last`: (-Dice, -bigrams, k, i, first word, word after)."""
        own, b = self.counts[k], self.sizes[k]
        low, high, share = self._bounds(b)
        stop = pos[i] + high - 1 if last is None else min(pos[i] + high - 1, last)
        left, shared, best = {}, 0, None
        for j in range(i, len(pos)):
            if pos[j] > stop:
                break
            w = pos[j] - pos[i] + 1
            c = codes[j]
            left[c] = n = left.get(c, 0) + 1
            shared += n <= own[c]
            if shared >= share and w >= low:
                dice = 2 * shared / (w + b)
                if dice >= self.least and (best is None or dice >= best[0]):
                    best = (dice, w, pos[j] + 2)
        return (-best[0], -best[1], k, i, pos[i], best[2]) if best else None


def templates_of(table: DataFrame, name_col: str = "licence", text_col: str = "text", most: int = 10_000) -> dict[str, tuple[str, ...]]:
    """The templates of a table (licence, text), null rows left out. They travel with the job, so more than `most` are an error."""
    rows = table.where(F.col(name_col).isNotNull() & F.col(text_col).isNotNull()).select(name_col, text_col).distinct().orderBy(name_col, text_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence templates")
    out: dict[str, tuple[str, ...]] = {}
    for name, text in rows:
        out[name] = (*out.get(name, ()), text)
    return out


@lru_cache(maxsize=2)
def _scanner(least: float) -> Scanner:
    return Scanner(TEMPLATES, least)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per licence stretch found: id, licence, dice, start_word, end_word (words are runs of a-z0-9 in lower case).

    Null and empty texts, texts of one word and tables without rows give no rows; repeated rows give their rows again;
    whole texts of any length are read, other columns take no part. templates: licence names with their texts, in place of
    TEMPLATES; templates_of makes them of a table. Among overlapping stretches the one with the higher coefficient, then the longer one, then the earlier template stays.
    """

    def make():
        scan = (Scanner(templates, least) if templates is not None else _scanner(least)).scan

        def step(batch: pa.RecordBatch) -> dict:
            got = [(row, *x) for row, t in enumerate(texts_of(batch.column(1))) for x in scan(t)]
            row, name, dice, start, end = zip(*got, strict=True) if got else [()] * 5
            return {"_id": batch.column(0).take(pa.array(row, pa.int64())), "licence": (name, pa.string()), "dice": (dice, pa.float64()), "start_word": (start, pa.int64()), "end_word": (end, pa.int64())}

        return step

    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, licence string, dice double, start_word long, end_word long"
    return by_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")), make, schema).withColumnRenamed("_id", id_col)
