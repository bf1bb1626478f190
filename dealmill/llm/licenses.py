"""License scans by patience alignment of texts with license templates.

A match covers at least ``coverage`` of a template's words in order, and they make up as much of the stretch of
text from the first to the last of them. So of any floor((1 - coverage) * n) + 1
template words one at least is in it. The places in the text of the words that are rarest there open windows;
in each window text and template are aligned: words unique to both are anchors, the longest increasing
subsequence of anchors stands, and the gaps between anchors are aligned in the same way, short gaps without
unique words by their longest common subsequence. Then words move next to the longest unbroken row of the
alignment, and outer words go until the rest is dense enough. A window without a match is aligned again closer
around each of its starts. Words that tell a license from others (names and
versions) have to be in the match, and a word that makes a variant of it (lesser, SA) must not be.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WORD = re.compile(r"(?<![^\W_])v(?=\d)|[^\W_]+")  # v3 is two words, like v. 3

# Words that tell licenses apart, besides version numbers, and words that make another license of one.
NAMES = frozenset("mit apache gnu cc nc creative commons attribution sharealike mozilla".split())
VARIANTS = frozenset("lesser affero nc nd sa noncommercial noderivatives noderivs sharealike".split())

# License notices as their authors word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-disclaimer": (
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a '
        "particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
        "of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "BSD-disclaimer": (
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties '
        "of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, "
        "incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or "
        "business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any "
        "way out of the use of this software, even if advised of the possibility of such damage."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
}


def _version(word: str) -> bool:
    """A version number; 2 and 2.0 are the same, and years are none."""
    return word.isdigit() and len(word) < 3 and word != "0"


def _longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by piles."""
    tops, last, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            back[i] = last[k - 1]
        if k == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, increasing in both, by patience alignment."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(text[a0:a1]), Counter(template[b0:b1])
        at_b = {w: j for j, w in enumerate(template[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        found = [(i, at_b[w]) for i, w in enumerate(text[a0:a1], a0) if w in at_b]
        if not found:
            keep = [i for i in range(a0, a1) if text[i] in in_b]  # other words can't take part
            out += [(keep[i], b0 + j) for i, j in _common_subsequence([text[i] for i in keep], template[b0:b1])]
            continue
        anchors = [found[k] for k in _longest_increasing([j for _, j in found])]
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def gather(pairs: list[tuple[int, int]], text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The same words of the template, each moved to its equal in the text next to the longest unbroken row of pairs."""
    if not pairs:
        return pairs
    first = best = start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            if k - start > best:
                first, best = start, k - start
            start = k
    out = list(pairs)
    for k in range(first - 1, -1, -1):
        i, j = out[k]
        out[k] = next(x for x in range(out[k + 1][0] - 1, i - 1, -1) if text[x] == template[j]), j
    for k in range(first + best, len(out)):
        i, j = out[k]
        out[k] = next(x for x in range(out[k - 1][0] + 1, i + 1) if text[x] == template[j]), j
    return out


@dataclass(frozen=True)
class Match:
    license: str
    matched: int
    coverage: float
    start: int  # code points of the text
    end: int


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = 0.8):
        self.coverage = coverage
        self.templates = {k: _WORD.findall(v.lower()) for k, v in (templates or TEMPLATES).items()}
        self.vocab = {k: Counter(v) for k, v in self.templates.items()}
        self.telling = {k: {w for w in v if w in NAMES or w in VARIANTS or _version(w)} for k, v in self.templates.items()}

    def scan(self, text: str) -> list[Match]:
        """Matches of all templates; those of one template don't overlap, better and earlier ones first chosen."""
        low = text.lower()
        if len(low) != len(text):  # lower-casing may lengthen; then fold letter by letter
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        present, spans, words, out = set(_WORD.findall(low)), None, [], []
        for name, template in self.templates.items():
            least = self._least(len(template))
            if not self.telling[name] <= present or sum(n for w, n in self.vocab[name].items() if w in present) < least:
                continue
            if spans is None:
                spans = [m.span() for m in _WORD.finditer(low)]
                words = [low[a:b] for a, b in spans]
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
            out += self._matches(name, template, least, words, places, spans)
        return sorted(out, key=lambda m: (m.start, m.end, m.license))

    def _least(self, n: int) -> int:
        return max(1, -(-int(round(self.coverage * n * 1000)) // 1000))

    def _matches(self, name, template, least, words, places, spans) -> list[Match]:
        n = len(template)
        rare = sorted(range(n), key=lambda j: (len(places.get(template[j], ())), j))[: n - least + 1]
        starts = sorted({i - j for j in rare for i in places.get(template[j], ())})
        slack, tight, found, k = n // 2 + 2, n - least, [], 0
        while k < len(starts):
            s, first = starts[k], k
            while k < len(starts) and starts[k] <= s + slack // 2:  # starts close by share a window
                k += 1
            lo, hi = max(0, s - slack), min(len(words), s + n + slack + slack // 2)
            got = self._dense(words, lo, hi, name, template, least)
            for s in starts[first:k] if not got else ():  # other words of the template around may hide a match in a wide window
                if s > -n:
                    got += self._dense(words, max(0, s - tight), min(len(words), s + n + tight), name, template, least)
                    got += self._dense(words, max(0, s), min(len(words), s + n), name, template, least)
            found += got
        taken, out = [], []
        for got, a, b in sorted(set(found), key=lambda f: (-f[0], f[1], f[2])):
            if all(b < x or y < a for x, y in taken):
                taken.append((a, b))
                out.append(Match(name, got, got / n, spans[a][0], spans[b][1]))
        return out

    def _dense(self, words, lo, hi, name, template, least) -> list[tuple[int, int, int]]:
        """(matched, first, last) of the matches in words[lo:hi]: what is beside one, or beside the widest hole
        of an alignment that holds none, is aligned by itself."""
        out, todo, seen, vocab = [], [(lo, hi)], set(), self.vocab[name]
        while todo:
            part = lo, hi = todo.pop()
            if part in seen or sum((Counter(w for w in words[lo:hi] if w in vocab) & vocab).values()) < least:
                continue
            seen.add(part)
            text = words[lo:hi]
            pairs = gather(align(text, template), text, template)
            if len(pairs) < least:
                continue
            run = self._run(pairs, text, self.telling[name], least)
            if run:
                a, b = lo + run[0][0], lo + run[-1][0]
                out.append((len(run), a, b))
                todo += [(lo, a), (b + 1, hi)]
            else:
                k = max(range(len(pairs) - 1), key=lambda k: pairs[k + 1][0] - pairs[k][0])
                todo += [(lo, lo + pairs[k + 1][0]), (lo + pairs[k][0] + 1, hi)]
        return out

    def _run(self, pairs, text, telling, least) -> list[tuple[int, int]]:
        """The most pairs in a row, shortest stretch first, that are enough, dense enough and of this license, or none."""
        for size in range(len(pairs), least - 1, -1):
            for k in sorted(range(len(pairs) - size + 1), key=lambda k: pairs[k + size - 1][0] - pairs[k][0]):
                if size < self.coverage * (pairs[k + size - 1][0] - pairs[k][0] + 1):
                    break
                if self._named(pairs[k : k + size], text, telling):
                    return pairs[k : k + size]
        return []

    @staticmethod
    def _named(run, text, telling) -> bool:
        """All telling words are matched, versions with no other one before them, and no word between makes a variant."""
        told, last = set(), run[0][0]
        for i, _ in run:
            between = text[last + 1 : i]
            if not VARIANTS.isdisjoint(between):
                return False
            if not (_version(text[i]) and any(map(_version, between))):
                told.add(text[i])
            last = i
        return telling <= told


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """Per match: doc_id, license, matched (words), coverage, start, end (code points of the text).

    ``documents`` has doc_id and text; other columns are ignored. Null, empty and unlicensed texts give no row;
    null and repeated doc_ids and repeated rows give their matches each; an empty table gives none. Texts are
    scanned whole, each by itself. A template that is part of another is reported beside it.
    """
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, license string, matched long, coverage double, start long, `end` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            found = [(i, m) for i, t in enumerate(batch.column("text").to_pylist()) if t for m in scanner.scan(t)]
            ids = batch.column("doc_id").take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([m.license for _, m in found], pa.string()), pa.array([m.matched for _, m in found], pa.int64()),
                 pa.array([m.coverage for _, m in found], pa.float64()), pa.array([m.start for _, m in found], pa.int64()), pa.array([m.end for _, m in found], pa.int64())],
                ["doc_id", "license", "matched", "coverage", "start", "end"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
