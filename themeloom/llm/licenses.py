"""License scans by patience alignment with templates.

A template and a stretch of text are aligned by their words: those that occur
exactly once in both are anchors, the longest increasing subsequence of the
anchors is kept, and the gaps between kept anchors are aligned in the same way;
a gap without anchors is matched word for word from its two ends. Coverage is
the share of the template's words that are aligned. A license is found where it
reaches ``coverage``.

Where to align: a finding holds at least one of the template's key words (the
words that only license terms use, see ``KEYS``). Each place of a key word gives
the stretch in which the template would lie, with ``SLACK`` of its length more
on both sides; all of them are aligned, in texts of any length.

Null and empty texts have no findings. Of findings that overlap in one text, the
one with more aligned words is reported; of equals, the one with the higher
coverage, then the first, then the first by name. Repeated rows are reported as often as they
occur. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD, disjoint, whole

COVERAGE, SLACK = 0.8, 0.25
KEYS = frozenset("license licensed licenses licence licensee spdx mit apache gpl gnu lgpl agpl mozilla mpl bsd isc cc0 unlicense unencumbered copyright copyrighted redistribution redistributions noncommercial sharealike attribution warranty warranties noninfringement merchantability".split()) | {"by", "nc", "sa", "nd"}
#: Keys that are also ordinary words: they place a template only together with another key.
WEAK = frozenset({"by", "nc", "sa", "nd", "mit", "attribution", "copyright", "warranty"})

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {}general public license for more details"
#: License by name, and the wordings that grant it.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "spdx-license-identifier apache-2.0",
    ),
    "MIT": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS,
        "spdx-license-identifier mit",
    ),
    "BSD-2-Clause": (f"{_BSD_2} {_BSD_END}", "licensed under the bsd 2 clause license", "spdx-license-identifier bsd-2-clause"),
    "BSD-3-Clause": (f"{_BSD_2} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}", "licensed under the bsd 3 clause license", "spdx-license-identifier bsd-3-clause"),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "spdx-license-identifier isc"),
    "GPL-2.0": (_GPL.format("", "2", ""), "this work is licensed under the gnu general public license version 2", "spdx-license-identifier gpl-2.0-only"),
    "GPL-3.0": (_GPL.format("", "3", ""), "this work is licensed under the gnu general public license version 3", "spdx-license-identifier gpl-3.0-only"),
    "AGPL-3.0": (_GPL.format("affero ", "3", "affero "), "this work is licensed under the gnu affero general public license version 3"),
    "LGPL-2.1": (_GPL.format("lesser ", "2.1", "lesser "), "licensed under the gnu lesser general public license version 2.1"),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "licensed under the mozilla public license version 2.0"),
    "Unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "CC0-1.0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1.0"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "CC-BY-ND-4.0": ("licensed under cc by-nd 4.0",),
}
_WORDS = re.compile(WORD)
#: Words without which a wording is another license: all numbers, and the names of licenses and their parts.
_NAMES = frozenset("mit apache gpl gnu lgpl agpl affero lesser mozilla mpl bsd isc cc cc0 by nc sa nd noncommercial sharealike noderivatives unencumbered neither".split())


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The lower-cased words and their places in characters. A text whose lower case has another length is taken as lower-cased for the places."""
    found = list(_WORDS.finditer(text.lower()))
    return [m[0] for m in found], [m.span() for m in found]


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a[w] == 1}
        anchors = [(p, place[w]) for p, w in enumerate(a[i:j], i) if w in place]
        kept = [anchors[x] for x in _increasing([y for _, y in anchors])]
        if kept:
            out += kept
            edges = [(i - 1, k - 1), *kept, (j, m)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class _Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)[0]
        self.names = Counter(w for w in self.words if w in _NAMES or w.isdigit())
        self.count = Counter(self.words)
        keys = [w for w in self.words if w in KEYS]
        self.keys = {w for w in keys if w not in WEAK} or set(keys)
        self.first: dict[str, list[int]] = {}
        for p, w in enumerate(self.words):
            if w in self.keys:
                self.first.setdefault(w, []).append(p)


_TEMPLATES = [_Template(name, text) for name, texts in TEMPLATES.items() for text in texts]
_PLACED = KEYS.union(*(t.names for t in _TEMPLATES))
#: What any text with a finding contains, for the scan that most texts end with: a key word that places a template.
HINT = "(?i)" + "|".join(sorted({w for t in _TEMPLATES for w in t.keys}))


def find(text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """``license, coverage, start, end`` (characters) of every license that the text grants, in order and apart."""
    if not text:
        return []
    words, spans = words_of(text)
    where: dict[str, list[int]] = {}
    for p, w in enumerate(words):
        if w in _PLACED:
            where.setdefault(w, []).append(p)

    def may_reach(t: _Template, low: int, high: int) -> bool:
        """Whether the words of a stretch, in whatever order, suffice for its names and coverage."""
        for w, times in t.names.items():
            at = where.get(w, ())
            if bisect_left(at, high) - bisect_left(at, low) < times:
                return False
        held = Counter(words[low:high])
        return sum(min(times, held[w]) for w, times in t.count.items()) >= coverage * len(t.words)

    found: dict[tuple[str, int, int], tuple[int, float]] = {}
    for t in _TEMPLATES:
        n = len(t.words)
        slack = int(n * SLACK) + 1
        tried = set()
        for key, offsets in t.first.items():
            for p in where.get(key, ()):
                for offset in offsets:
                    low, high = max(0, p - offset - slack), min(len(words), p - offset + n + slack)
                    if (low, high) in tried:
                        continue
                    tried.add((low, high))
                    if not may_reach(t, low, high):
                        continue
                    pairs = align(t.words, words[low:high])
                    if len(pairs) < coverage * n or t.names - Counter(t.words[i] for i, _ in pairs):
                        continue
                    start, end = low + pairs[0][1], low + pairs[-1][1] + 1
                    place = (t.name, spans[start][0], spans[end - 1][1])
                    found[place] = max(found.get(place, (0, 0.0)), (len(pairs), len(pairs) / n))
    best = sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0][1], x[0][0]))
    return [(name, share, start, end) for start, end, name, share in disjoint((start, end, name, share) for (name, start, end), (_, share) in best)]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        rows = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), HINT), False))
        found = [(doc, *x) for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for x in find(text)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, license, coverage, start, end`` of every finding; places are in characters."""
    return docs.select(whole("doc_id"), "text").mapInArrow(_scan_batches, "doc_id long, license string, coverage double, start int, end int")
