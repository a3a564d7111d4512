"""License scans by conditional compression.

A document is cut into units (the sentences of lines). Units with a cue (license, copyright, warranty, ...) and the few
units between them are a candidate block. Notices are sought in a block and in as many words before and after it as a notice may
have. Where a window has enough of a template's words, they are aligned one by one (at least ``COVER`` of the template's words in
order); the words of each such place are compressed by zstandard alone, and again with the template as a raw dictionary: the more
of its wording they have, the smaller they get. Places are ranked by the bytes saved; the best takes its words, and templates are
aligned again with the words still free until none fits. Words that are missing or added are reported. A verdict is ``exact`` (the
template's words in one run), ``modified`` (with differences) or ``unknown`` (a block that no notice touches).

One pass over the documents without a shuffle; texts without a cue never leave the JVM. Unknown blocks that repeat are compressed once in
a worker's bounded memory.

Defined results: null or empty texts, and texts without cues, have no rows; positions (of a notice's words, or of an
unknown block) count code points, ends are exclusive.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Share of a template's words that a notice must have, in order; and of those of its words that no other license has.
COVER = 0.8
#: Units without a cue that may stand between two units of one block.
GAP = 4
LEVEL = 9
#: Unknown blocks that a worker remembers.
MEMO = 20_000
#: What stands between the words of a cue: also a line's end and the marks of a comment.
_BETWEEN = r"[\s#*/;%|>!-]{1,12}"
CUE = r"(?i)licen[cs]|copyright|©|rights reserved|permission is hereby|without warrant|warranty|public domain|creative commons|\bcc-by\b|\bcc by\b|\bcc0\b|redistribution and use|gnu (?:lesser |affero )?general public".replace(" ", _BETWEEN)

#: Notices of common licenses, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."],
    "all-rights-reserved": ["All rights reserved."],
}
#: What follows the notices above in the whole texts of short licenses, and one more license.
TAILS = {
    "MIT": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
for _name, _tail in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD"), ("BSD-3-Clause", "BSD")):
    TEMPLATES[_name] = [*TEMPLATES[_name], f"{TEMPLATES[_name][-1]} {TAILS[_tail]}"]
TEMPLATES["Zlib"] = [TAILS["Zlib"]]
for _name in [n for n in TEMPLATES if n != "all-rights-reserved"]:  # the short form by identifier
    _forms = [f"{_name}-only", f"{_name}-or-later"] if "GPL" in _name else []
    TEMPLATES[_name] = [*TEMPLATES[_name], *[f"SPDX-License-Identifier: {x}" for x in [_name, *_forms]]]
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*", re.UNICODE)
SCHEMA = "block int, start long, end long, license string, saved int, reduction double, coverage double, verdict string, missing array<string>, added array<string>"
_ARROW = [("block", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.int32()), ("reduction", pa.float64()), ("coverage", pa.float64()), ("verdict", pa.string()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def flat(text: str) -> bytes:
    """What is compressed: lower case, single blanks."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def units(text: str) -> list[tuple[int, int]]:
    """The sentences of lines, as (start, end)."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        at = line.start()
        for stop in re.finditer(r"(?<=[^.\s]{2}[.!?])\s+(?=\S)", line[0]):
            out.append((at, line.start() + stop.start()))
            at = line.start() + stop.end()
        out.append((at, line.end()))
    return out


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks as (start, end), from their first to their last unit with a cue."""
    parts, found, last = units(text), [], None
    starts, ends = [a for a, _ in parts], [b for _, b in parts]
    for m in re.finditer(CUE, text):
        i, stop = bisect_right(ends, m.start()), bisect_left(starts, m.end())
        if i >= stop:
            continue
        if last is not None and i - last <= GAP + 1:
            found[-1] = (found[-1][0], ends[stop - 1])
        else:
            found.append((starts[i], ends[stop - 1]))
        last = stop - 1
    return found


def most_added(template: list[str]) -> int:
    """Words that a notice may have between those of its template."""
    return int((1 - COVER) * len(template) + 1 + 1e-9)


def densest(template: list[str], own: list[str | None]) -> list[int]:
    """Ends of the windows of own that have enough of the template's words in any order, those with the most first.

    A window is as long as a notice may be, so that every notice is in the window that ends with its last word."""
    want, size = Counter(template), len(template) + most_added(template)
    at = [k for k, w in enumerate(own) if w in want]
    need, have, common, low, found = COVER * len(template) - 1e-9, Counter(), 0, 0, []
    for k in at:
        have[own[k]] += 1
        common += have[own[k]] <= want[own[k]]
        while at[low] <= k - size:
            w = own[at[low]]
            common -= have[w] <= want[w]
            have[w] -= 1
            low += 1
        if common >= need:
            found.append((-common, k + 1))
    return [k for _, k in sorted(found)]


@dataclass
class Notice:
    """Words first to stop of a text as a notice of a template."""

    template: int
    first: int
    stop: int
    cover: float
    missing: list[str]
    added: list[str]
    saved: int = 0
    reduction: float = 0.0


@dataclass
class Judge:
    """Finds the places where templates fit, and ranks them."""

    templates: dict[str, list[str]]

    def __post_init__(self) -> None:
        self.known = [(name, words(t), self._with(t)) for name, ts in self.templates.items() for t in ts]
        held = {name: {w for t in ts for w in words(t)} for name, ts in self.templates.items()}
        self.telling = {name: own - set().union(*[x for other, x in held.items() if other != name]) for name, own in held.items()}
        self.reach = max((len(t) + most_added(t) for _, t, _ in self.known), default=0)
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.memo: dict[bytes, tuple] = {}

    @staticmethod
    def _with(template: str) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(flat(template), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)

    def unknown(self, text: str) -> tuple[int, float]:
        """Most bytes that a template saves of a block, and their share."""
        block = flat(text)
        if block not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            plain = len(self.alone.compress(block))
            saved = max([0, *(plain - len(c.compress(block)) for _, _, c in self.known)])
            self.memo[block] = (saved, saved / max(1, plain))
        return self.memo[block]

    def fit(self, i: int, left: list[str | None], low: int, stop: int) -> Notice | None:
        """The notice of template i in the window low to stop of left."""
        name, template, _ = self.known[i]
        window = left[low:stop]
        runs = [m for m in difflib.SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() if m.size]
        # of the runs, the neighbours with the most words beyond those that stand between them: others are words of the text around
        best, start, score = (0, 0, 0), 0, 0
        for k, m in enumerate(runs):
            gap = m.b - runs[k - 1].b - runs[k - 1].size if k else 0
            if score - gap < 0:
                start, score, gap = k, 0, 0
            score += m.size - gap
            if score >= best[0]:
                best = (score, start, k + 1)
        runs = runs[best[1] : best[2]]
        cover = sum(m.size for m in runs) / max(1, len(template))
        if not runs or cover < COVER:
            return None
        first, stop = runs[0].b, runs[-1].b + runs[-1].size
        hit = {m.b + k for m in runs for k in range(m.size)}
        had = {m.a + k for m in runs for k in range(m.size)}
        between = [k for k in range(first, stop) if k not in hit]
        if len(between) > most_added(template) or any(window[k] is None for k in between):
            return None
        missing = [w for k, w in enumerate(template) if k not in had]
        telling = self.telling[name]
        if any(ch.isdigit() for w in missing for ch in w) or sum(w in telling for w in missing) > (1 - COVER) * sum(w in telling for w in template) + 1e-9:
            return None  # another version or another name is another license
        return Notice(i, low + first, low + stop, cover, missing, [window[k] for k in between])

    def fits(self, i: int, own: list[str | None]) -> list[Notice]:
        """All places of template i, none over another."""
        left, out = list(own), []
        template = self.known[i][1]
        added = most_added(template)
        for stop in densest(template, left):
            found = self.fit(i, left, max(0, stop - len(template) - added), stop)
            while found is not None:  # words of the text around may have stood for words beyond the window
                more = len(found.missing) + added
                wider = self.fit(i, left, max(0, found.first - more), found.stop + more)
                if wider is None or len(wider.missing) + len(wider.added) >= len(found.missing) + len(found.added):
                    break
                found = wider
            if found is not None:
                left[found.first : found.stop] = [None] * (found.stop - found.first)
                out.append(found)
        return out

    def notices(self, text: str, spans: list[tuple[int, int]], own: list[str]) -> list[Notice]:
        """The notices among words own at spans of text: those that save the most bytes first, then what fits the words still free."""
        free: list[str | None] = list(own)
        out: list[Notice] = []
        todo = range(len(self.known))
        while True:
            found = [n for i in todo for n in self.fits(i, free)]
            if not found:
                return out
            for n in found:
                notice = flat(text[spans[n.first][0] : spans[n.stop - 1][1]])
                plain = len(self.alone.compress(notice))
                n.saved = plain - len(self.known[n.template][2].compress(notice))
                n.reduction = n.saved / max(1, plain)
            for n in sorted(found, key=lambda n: (-n.saved, n.template, n.first)):
                if None not in free[n.first : n.stop]:
                    free[n.first : n.stop] = [None] * (n.stop - n.first)
                    out.append(n)
            todo = sorted({n.template for n in found})

    def judge(self, text: str) -> list[tuple]:
        """(block, start, end, license, saved, reduction, coverage, verdict, missing, added) for every notice, and for blocks without one."""
        cued = blocks(text)
        if not cued:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        near: list[list[int]] = []  # words about blocks, as far as a notice may reach
        for a, b in cued:
            low, high = max(0, bisect_right(ends, a) - self.reach), min(len(spans), bisect_left(starts, b) + self.reach)
            if near and low <= near[-1][1]:
                near[-1][1] = high
            else:
                near.append([low, high])
        out, told = [], set()
        for low, high in near:
            part = spans[low:high]
            for n in self.notices(text, part, [text[a:b].lower() for a, b in part]):
                start, end = part[n.first][0], part[n.stop - 1][1]
                held = [k for k, (a, b) in enumerate(cued) if a < end and b > start]
                told.update(held)
                block = held[0] if held else min(range(len(cued)), key=lambda k: max(cued[k][0] - end, start - cued[k][1]))
                verdict = "exact" if not n.missing and not n.added else "modified"
                out.append((block, start, end, self.known[n.template][0], n.saved, n.reduction, n.cover, verdict, n.missing, n.added))
        for k, (a, b) in enumerate(cued):
            if k not in told:
                saved, reduction = self.unknown(text[a:b])
                out.append((k, a, b, None, saved, reduction, 0.0, "unknown", [], []))
        return sorted(out, key=lambda r: r[:3])


def _rows(templates: dict[str, list[str]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(templates)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"doc_id": doc} | dict(zip(schema.names[1:], x, strict=True)) for x in judge.judge(text)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for every license found in a candidate block of docs (doc_id, text), and for blocks without a known license."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(CUE))
    return rows.mapInArrow(_rows(templates or TEMPLATES, pa.schema([("doc_id", pa.int64()), *_ARROW])), "doc_id long, " + SCHEMA)
