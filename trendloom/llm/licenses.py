"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Each template has fingerprints: hashes of pairs of neighbouring words, of which the least of
each two in a row is kept (winnowing), so any three of its words in a row hold one. A template
of fewer than SHORT words has single words instead, as many as coverage leaves no way
around, the rarest by the templates themselves. The inverted index from fingerprint to
template and place is small and broadcast; its size is checked. All pairs and words of a text
are looked up in it: which places are candidates depends on the text and the templates alone.

Where the text around a hit has enough of the template's words, a banded alignment of the
template's words against it gives a stretch; what is left of the template is aligned before
and after it, on the diagonals that most of its words lie on, until no stretch of due length
is found. Stretches in order are one match, whatever was put in between, within `max_inserted`
words before and after the place that the hit gives the template. Matches that cover enough of
a template are reported, with the words between stretches counted in `inserted_words`.

Texts are read in tasks and nothing is shuffled. Words: lower-cased ASCII letters, digits
and all non-ASCII characters; spans are code points, end exclusive. A scan finds the words of
a notice; whether a sentence around it denies it ("is not released under") is not its business.

Edge cases: null and empty texts have no matches; very long texts are scanned whole;
templates without words are ignored; repeated rows are scanned one by one; a text that holds a
template several times has a span for each; of equally good alignments at a hit the first
counts, and templates of equal coverage each have their row; an empty table or no templates
give no rows; input columns other than the id are left out of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import slices, small_batches
from trendloom.llm.decontam import _FOLD
from trendloom.llm.neardup import word_hashes

BAND = 12
COVERAGE = 0.8
#: A template of fewer words has fingerprints of single words.
SHORT = 20
#: Words that may stand before or after a hit beyond the template's own.
MAX_INSERTED = 400
#: The templates' words together, at most: the index is broadcast.
MAX_TEMPLATE_WORDS = 2_000_000

#: Public license notices (fixed values).
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
    "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Fingerprints of two words in a row, from theirs."""
    return (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0xD6E8FEB86659FD93))


def fragment(n: int) -> int:
    """Words at least of a stretch that is matched apart from the best one of a template of n words."""
    return max(2, min(5, n // 4))


class Index:
    """Templates' words: the sorted vocabulary, and number in it, template and place of each
    word; and the fingerprints in order, with the template and place of each."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words = [[w.group().translate(_UPPER) for w in _WORD.finditer(templates[n])] for n in self.names]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.least = np.maximum(np.ceil(coverage * self.length - 1e-9), 1).astype(np.int64)
        prints = word_hashes(" ".join(w for words in self.words for w in words).encode())[0]
        self.vocabulary, self.word = np.unique(prints, return_inverse=True)
        common = Counter(w for words in self.words for w in words)
        one: list[tuple[int, int, int]] = []
        two: list[tuple[int, int, int]] = []
        for t, words in enumerate(self.words):
            own = prints[self.start[t] : self.start[t] + len(words)]
            if len(words) < SHORT:
                places = sorted(range(len(words)), key=lambda i: (common[words[i]], -len(words[i]), i))[: len(words) - int(self.least[t]) + 1]
                one += [(int(own[i]), t, i) for i in places]
            else:
                pairs = _pairs(own[:-1], own[1:])
                kept = {i if pairs[i] < pairs[i + 1] else i + 1 for i in range(len(pairs) - 1)}
                two += [(int(pairs[i]), t, i) for i in sorted(kept)]
        self.one, self.two = (self._sorted(x) for x in (one, two))

    @staticmethod
    def _sorted(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sorted(rows)
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


def align(template: list[str], text: list[str], lead: int) -> tuple[int, int, int, int, int]:
    """Local alignment of words in a band around text place = template place + lead: 2 for
    a match, -1 for a mismatch or a gap. Returns (matched words, first and last + 1 of the
    aligned words of text, and of template)."""
    score, best = 0, (0, 0, 0, 0, 0)
    above: dict[int, tuple[int, int, int, int]] = {}  # text place -> (score, matched, first of text, of template)
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + lead - BAND), min(len(text), i + lead + BAND + 1)):
            s, n, first, own = above.get(j - 1, (0, 0, j, i))
            cell = (s + 2, n + 1, first, own) if word == text[j] else (s - 1, n, first, own)
            for gap in (above.get(j), row.get(j - 1)):
                if gap and gap[0] - 1 > cell[0]:
                    cell = (gap[0] - 1, *gap[1:])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > score:
                    score, best = cell[0], (cell[1], cell[2], j + 1, cell[3], i + 1)
        above = row
    return best


def chain(template: list[str], text: list[str], lead: int, least: int | None = None) -> tuple[int, int, int]:
    """Stretches of a banded alignment in the order of the template, found around the best
    one: (matched words, first and last + 1 of text). A further stretch has least words."""
    least = fragment(len(template)) if least is None else least
    n, a, b, i, j = align(template, text, lead)
    if not n:
        return 0, 0, 0
    for before in (True, False):
        part, rest = (template[:i], text[:a]) if before else (template[j:], text[b:])
        if len(part) < least or len(rest) < least:
            continue
        places: dict[str, list[int]] = {}
        for k, w in enumerate(part):
            places.setdefault(w, []).append(k)
        diagonals = Counter(y - k for y, w in enumerate(rest) for k in places.get(w, ()))
        if diagonals:
            at = max(diagonals, key=lambda x: (diagonals[x], -abs(x if not before else x - len(rest) + len(part)), x))
            m, c, d = chain(part, rest, at, least)
            if m >= least:
                n, a, b = (n + m, c, b) if before else (n + m, a, b + d)
    return n, a, b


def _looked_up(prints: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in prints, template, place in it) of each fingerprint found in the index."""
    low, high = np.searchsorted(table[0], prints, "left"), np.searchsorted(table[0], prints, "right")
    at = np.flatnonzero(high > low)
    n = (high - low)[at]
    hit = np.repeat(low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(at, n), table[1][hit], table[2][hit]


def _hits(texts: list[bytes], index: Index, max_inserted: int = MAX_INSERTED) -> dict[int, list[tuple[int, int, int]]]:
    """Text number -> (template, text place, template place) of each hit that has enough of
    the template's words around."""
    folded = [t.translate(_FOLD) for t in texts]
    hashes, start = word_hashes(b" ".join(folded))
    none = len(index.vocabulary)
    if not len(hashes) or not none:
        return {}
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in folded]), start, "right")
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    word = np.minimum(np.searchsorted(index.vocabulary, hashes), none - 1)
    word[index.vocabulary[word] != hashes] = none
    known = np.flatnonzero(word < none)
    pair = known[:-1][(np.diff(known) == 1) & (owner[known[:-1]] == owner[known[1:]])]
    found = [_looked_up(hashes[known], index.one), _looked_up(_pairs(hashes[pair], hashes[pair + 1]), index.two)]
    at = np.concatenate([known[found[0][0]], pair[found[1][0]]])
    template, place = (np.concatenate([f[i] for f in found]) for i in (1, 2))
    by = np.lexsort((place, at, template))
    at, template, place = at[by], template[by], place[by]
    shift, text = at - place, owner[at]
    lo = np.maximum(first[text], shift - max_inserted)
    hi = np.minimum(first[text + 1], shift + index.length[template] + max_inserted)
    out: dict[int, list[tuple[int, int, int]]] = {}
    local = np.zeros(none + 1, np.int64)  # a template's words from 1 on, 0: another word
    ends = np.searchsorted(template, np.arange(len(index.words) + 1))
    for t in np.flatnonzero(np.diff(ends)).tolist():
        own, want = np.unique(index.word[index.start[t] : index.start[t] + index.length[t]], return_counts=True)
        local[own] = np.arange(1, len(own) + 1)
        here = local[word]
        local[own] = 0
        held = np.concatenate(([0], np.cumsum(here > 0)))
        mine = np.arange(ends[t], ends[t + 1])
        enough: dict[tuple[int, int], bool] = {}  # hits of one window count its words once
        for x in mine[held[hi[mine]] - held[lo[mine]] >= index.least[t]].tolist():
            window = int(lo[x]), int(hi[x])
            if window not in enough:
                have = np.bincount(here[window[0] : window[1]], minlength=len(own) + 1)[1:]
                enough[window] = int(np.minimum(have, want).sum()) >= index.least[t]
            if enough[window]:
                d = int(text[x])
                out.setdefault(d, []).append((t, int(at[x] - first[d]), int(place[x])))
    return out


def _occurrences(words: list[str], template: list[str], hits: list[tuple[int, int]], least: int, max_inserted: int) -> list[tuple[int, int, int]]:
    """Every occurrence of template around the hits, (text place, template place) in order:
    (matched words, first and last + 1 word), not overlapping. A hit outside the occurrences
    so far is aligned in the text after them, and where another occurrence aligns better,
    again in the text on the hit's side of that one."""
    taken: list[tuple[int, int, int]] = []
    known: dict[tuple, tuple[int, int, int]] = {}  # hits of one diagonal align once

    def found(lo: int, hi: int, shift: int) -> tuple[int, int, int]:
        key = (lo, hi, shift)
        if key not in known:
            n, a, b = chain(template, words[lo:hi], shift - lo)
            known[key] = (n, lo + a, lo + b)
        return known[key]

    for place, group in groupby(hits, key=lambda h: h[0]):
        end = taken[-1][2] if taken else 0
        if place < end:
            continue
        best = (0, 0, 0)
        for _, i in group:
            shift = place - i
            lo, hi = max(end, shift - max_inserted), min(len(words), shift + len(template) + max_inserted)
            while hi - lo >= least:
                n, a, b = found(lo, hi, shift)
                if n < least:
                    break
                if a <= place < b:
                    best = max(best, (n, a, b), key=lambda x: (x[0], x[1] - x[2]))
                    break
                lo, hi = (lo, a) if place < a else (b, hi)
        if best[0]:
            taken.append(best)
    return taken


def _matches(text: str, hits: list[tuple[int, int, int]], index: Index, max_inserted: int = MAX_INSERTED) -> list[dict]:
    spots = list(_WORD.finditer(text))
    words = [m.group().translate(_UPPER) for m in spots]
    out = []
    for t, own in groupby(sorted(set(hits)), key=lambda h: h[0]):
        taken = _occurrences(words, index.words[t], [h[1:] for h in own], int(index.least[t]), max_inserted)
        if not taken:
            continue
        most, extra = max((n, n - (b - a)) for n, a, b in taken)  # of equally good ones the tightest
        out.append({"license_id": index.names[t], "matched_words": most, "template_words": len(index.words[t]), "coverage": most / len(index.words[t]), "inserted_words": max(-extra, 0), "spans": [{"start": spots[a].start(), "end": spots[b - 1].end()} for _, a, b in taken]})
    return out


_FOUND = "array<struct<license_id:string,matched_words:bigint,template_words:bigint,coverage:double,inserted_words:bigint,spans:array<struct<start:bigint,end:bigint>>>>"


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, max_inserted: int = MAX_INSERTED) -> DataFrame:
    """(id_col, license_id, matched_words, template_words, coverage, inserted_words, spans): a row for each
    text and template of which at least `coverage` is matched."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, coverage))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.list_(pa.struct([("license_id", pa.string()), ("matched_words", pa.int64()), ("template_words", pa.int64()), ("coverage", pa.float64()), ("inserted_words", pa.int64()), ("spans", span)]))

    @F.arrow_udf(_FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[list[dict]] = []
            for part in slices(texts):
                hits = _hits([t.encode() for t in part], shared.value, max_inserted)
                out += [_matches(t, hits[i], shared.value, max_inserted) if i in hits else [] for i, t in enumerate(part)]
            yield pa.array(out, kind)

    found = docs.select(F.col(id_col), F.explode(scan(F.coalesce(F.col(text_col), F.lit("")))).alias("_found"))
    return found.select(F.col(id_col), "_found.*")
