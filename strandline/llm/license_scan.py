"""License scans by patience alignment (operator 3).

Of a text the words that a template has (its hits) are looked at. A run of hits ends where over SLACK times the template's
length of other words follow each other (at least LEAST_SLACK). Within a run every stretch of up to REACH times the
template's length of hits that can hold enough of its words is a window: it begins at a hit that can be the first aligned
one and ends at one that can be the last, so what stands before a notice or between its words cuts nothing. Within a
window the words that occur once in both window and template are anchors; the longest increasing subsequence of their
places is kept, and the gaps between neighbouring anchors are aligned the same way. Equal hits right beside an anchor or a
gap's end count as well. Coverage is the share of the template's words that are aligned.

For a template of over SHORT words, windows with one beginning end at up to about 20 places, ever further apart, and the
best alignment is made again between its own ends.

Words are [a-z0-9]+ of the lower-cased text. Defined results: a null or empty text has no words and no license; ties go
to the template listed first, then to the window that begins first; rows with one id or a null id, and repeated rows, each
stay a row; texts of any length are scanned whole; an empty table gives no rows; columns other than id and text are
ignored whatever their names. A text has one match at most of each template, its best. A match is left out where a longer one of
another template spans it, as a header spans its own first line, or one as long that covers its template better.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ready

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gpl(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."


#: Notices as licenses ask for them, headers, whole short texts, and the opening words of long ones.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": _WARRANTY,
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-notice": "Released under the BSD License.",
    "ISC-notice": "Released under the ISC License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0-header": _gpl("GNU General Public License", "2"),
    "GPL-3.0-header": _gpl("GNU General Public License", "3"),
    "LGPL-2.1-header": _gpl("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _gpl("GNU Lesser General Public License", "3"),
    "AGPL-3.0-header": _gpl("GNU Affero General Public License", "3"),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_3} {_BSD_END}",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "All-rights-reserved": "All rights reserved.",
}
#: Words that tell a template from its kin: an occurrence has them all.
KEYS = {name: set(re.findall(r"mit|apache|gnu|lesser|affero|bsd|isc|mozilla|cc|by|nc|sa|nd|[0-9]+", name.lower().replace("agpl", "affero gnu").replace("lgpl", "lesser gnu").replace("gpl", "gnu").replace("mpl", "mozilla"))) for name in TEMPLATES if name.endswith(("-notice", "-header", "-text"))}
#: Rights notices are the best match of a text only where it has no license.
WEAK = {"All-rights-reserved"}
_WORD = re.compile(r"[a-z0-9]+")
#: Foreign words in a row that don't end a run of hits, and hits of a window, in template lengths.
SLACK, LEAST_SLACK, REACH = 2, 8, 4
SHORT = 32


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
        before[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) in order."""
    out = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict = {}
        for k in range(c, d):
            once[template[k]] = -1 if template[k] in once else k
        there: dict = {}
        for k in range(a, b):
            if once.get(text[k], -1) >= 0:
                there[text[k]] = -1 if text[k] in there else k
        anchors = sorted((k, once[w]) for w, k in there.items() if k >= 0)
        kept = [anchors[k] for k in increasing([q for _, q in anchors])]
        if not kept:
            continue
        out.extend(kept)
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo.extend((p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:], strict=True))
    return sorted(out)


def spread(places: list[int]) -> list[int]:
    """Some of places: the first ones, then ever fewer, and the last."""
    out, k = [], 0
    while k < len(places):
        out.append(places[k])
        k += 1 + k // 3
    return out if not places or out[-1] == places[-1] else [*out, places[-1]]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.names = list(templates)
        self.templates = [words_of(t) for t in templates.values()]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for t in self.templates for w in t))}
        self.coded = [[self.ids[w] for w in t] for t in self.templates]
        self.need = np.array([max(1, int(np.ceil(least * len(t) - 1e-9))) for t in self.templates], np.int64)
        # An occurrence needs the places of these words; of templates given by the caller, none.
        self.keys = [{w for w in KEYS.get(n, ()) if w in t} if TEMPLATES.get(n) == templates[n] else set() for n, t in zip(self.names, self.templates, strict=True)]
        self.counts = np.array([np.bincount(t, minlength=len(self.ids)) for t in self.coded], np.int64).reshape(len(self.coded), -1)

    def _windows(self, k: int, words: list[int], a: int, b: int) -> list[tuple[int, int, int, int]]:
        """For each place in words[a:b] where an occurrence can begin: the least place where it can end, the place itself, where its window stops, and how many words can be aligned in that."""
        template, need = self.coded[k], int(self.need[k])
        reach, heads = REACH * len(template), set(template[: len(template) - need + 1])
        limit = Counter(template)

        def slide(most: int) -> list[tuple[int, int]]:
            """For each begin the end at which `most` words can be aligned, or as far as a window goes, and how many can."""
            left, able, end, out = dict(limit), 0, a, []
            for begin in range(a, b):
                while end < min(b, begin + reach) and able < most:
                    able += left[words[end]] > 0
                    left[words[end]] -= 1
                    end += 1
                out.append((end, able))
                left[words[begin]] += 1
                able -= left[words[begin]] > 0
            return out

        fewest, most = slide(need), slide(len(template))
        return [(fewest[i - a][0] - 1 - i, i, min(b, i + reach), most[i - a][1]) for i in range(a, b) if fewest[i - a][1] >= need and words[i] in heads]

    def _find(self, k: int, words: list[int], at: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (place in words, place in the template) of the best occurrence, none if it has too few."""
        template, need = self.coded[k], int(self.need[k])
        m = len(template)
        tails, keys = set(template[need - 1 :]), {self.ids[w] for w in self.keys[k]}
        cuts = [0, *(np.flatnonzero(np.diff(at) - 1 > max(LEAST_SLACK, SLACK * m)) + 1).tolist(), len(words)]
        windows = [w for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= need for w in self._windows(k, words, a, b)]
        best: list[tuple[int, int]] = []
        for extent, i, stop, able in sorted(windows):  # the densest first: fewer of the others can be better then
            if best and (able, -i) <= (len(best), -best[0][0]):
                continue
            ends = [j for j in range(i + extent, stop) if words[j] in tails]
            for j in ends if m <= SHORT else spread(ends):
                pairs = [(i + p, q) for p, q in align(words[i : j + 1], template)]
                while m > SHORT and len(pairs) >= need:
                    first = pairs[0][0]
                    again = [(first + p, q) for p, q in align(words[first : pairs[-1][0] + 1], template)]
                    if len(again) <= len(pairs):
                        break
                    pairs = again
                if not keys <= {template[q] for _, q in pairs}:
                    continue
                if len(pairs) >= need and (not best or (len(pairs), -pairs[0][0]) > (len(best), -best[0][0])):
                    best = pairs
                if len(pairs) == m:
                    break
        return best

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Each template that is covered, its coverage, and the span of the words that cover it, in the order of the templates."""
        known, none = self.ids, len(self.ids)
        coded = np.array([known.get(w, none) for w in words_of(text)], np.int64)
        hits = np.flatnonzero(coded < none)
        if not len(hits) or not len(self.need) or len(hits) < self.need.min():
            return []
        # How often each word is in both bounds what can be aligned.
        able = np.minimum(self.counts, np.bincount(coded[hits], minlength=none)).sum(axis=1)
        found = []
        for k in np.flatnonzero(able >= self.need).tolist():
            at = hits[self.counts[k, coded[hits]] > 0]
            pairs = self._find(k, coded[at].tolist(), at)
            if pairs:
                coverage = len(pairs) / len(self.coded[k])
                found.append((len(pairs), (self.names[k], coverage, int(at[pairs[0][0]]), int(at[pairs[-1][0]]) + 1)))
        return [x for n, x in found if not any(y[2] <= x[2] and x[3] <= y[3] and (o, y[1]) > (n, x[1]) for o, y in found)]

    @staticmethod
    def best(found: list[tuple[str, float, int, int]]) -> tuple[str | None, float, int, int]:
        return max(found, key=lambda x: (x[0] not in WEAK, x[1]), default=(None, 0.0, 0, 0))

    def scan(self, text: str | None) -> tuple[str | None, float, int, int]:
        """The template best covered, its coverage, and the span of the words that cover it."""
        return self.best(self.matches(text))


def load_templates(folder: str) -> dict[str, str]:
    """Templates out of a folder on every machine with a text file for each license, by the files' names: whole bodies as published."""
    from pathlib import Path

    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).glob("*.txt"))}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (null if none is covered), coverage, first_word, last_word: the span of the words that cover it, and matches: the same of every template that is covered."""
    ready(docs.sparkSession)
    given = dict(templates or TEMPLATES)
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
    names = ["license", "coverage", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, least)
        for batch in batches:
            every = [scanner.matches(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*map(scanner.best, every), strict=True)) or [[]] * 4
            matches = pa.array([[dict(zip(names, x, strict=True)) for x in found] for found in every], pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), matches], ["doc_id", *names, "matches"])

    fields = "license string, coverage double, first_word long, last_word long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {fields}, matches array<struct<{fields}>>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices that each text of documents contains."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}
