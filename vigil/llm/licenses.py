"""License scan: winnowed fingerprints pick candidates, banded sequence alignment measures them.

The templates (name and text) are cut into words; hashes of ``GRAM`` neighbouring words are
winnowed (the smallest of each ``WINDOW`` neighbours), so any ``GRAM + WINDOW - 1`` words in
common share a fingerprint. An inverted index from fingerprint to (template, place) is held by
every task: its size is that of the templates, which are code, not data. Documents are
winnowed by the same rule. Hits of a template with similar shifts propose a stretch of the
document, and a banded alignment (words equal or not, gaps within ``BAND``) of template and
stretch gives the words matched, the coverage of the template and the span in the text.

Coverage alone does not name a license: most words of a short notice are those of any such
sentence, and versions differ by a word. So each template has marks, the phrases that tell its
license and version; a match counts only if its span holds all of them, word after word.

A stretch of text is reported for the template that matches most of its words; templates
whose match lies within that span are left out (a full notice contains its short form).
Words: white-space separated, lower case, letters and digits only. Spans are code points, end
exclusive. Everything happens where a text is read; nothing is shuffled.

Nulls: a null or empty text matches nothing; a null id is kept as null. Repeated rows are
reported each. Empty tables give no rows. Other columns are ignored. Very long texts are
scanned whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import out_batch, slabs, small_batches, table, text_or_empty
from vigil.llm.grams import window_min
from vigil.llm.words import alnum, gram_hashes, word_hashes

GRAM, WINDOW, BAND = 3, 2, 8
MIN_COVER = 60
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Well-known license notices; the parts of whole texts come first.
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
              "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
              "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
              "subject to the following conditions:")
_BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                "conditions are met:")
_BSD_TWO = (" 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
            "in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              "from this software without specific prior written permission.")
_BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
            "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
            "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
              "the above copyright notice and this permission notice appear in all copies.")
# Name, text, and the marks, parted by semicolons.
TEMPLATES = [
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", _MIT_GRANT, "deal in the software; following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache license version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     "gnu general public license; version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
     "gnu general public license; version 2"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                 "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     "gnu lesser general public license; version 3"),
    ("BSD-2-Clause OR BSD-3-Clause", _BSD_OPENING, "source and binary forms; following conditions"),  # both begin so
    ("ISC", _ISC_GRANT, "distribute this software for any purpose; provided that the above copyright notice"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public license v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
     "waived all copyright"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    # Whole texts.
    ("MIT", _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "deal in the software; following conditions; substantial portions"),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_TWO + _BSD_END, "source and binary forms; redistributions in binary form"),
    ("BSD-3-Clause", f"{_BSD_OPENING}{_BSD_TWO} 3. {_BSD_NAMES}{_BSD_END}", "source and binary forms; redistributions in binary form; endorse or promote products"),
    ("BSD-4-Clause", f"{_BSD_OPENING}{_BSD_TWO} 3. All advertising materials mentioning features or use of this software must display the following "
                     f"acknowledgement: This product includes software developed by the organization. 4. {_BSD_NAMES}{_BSD_END}",
     "source and binary forms; redistributions in binary form; advertising materials; endorse or promote products"),
    ("ISC", _ISC_GRANT + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
            "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
     "distribute this software for any purpose; provided that the above copyright notice; author disclaims"),
]
ROWS = "doc_id long, license string, template int, matched long, template_words long, coverage_percent long, start long, end long, similarity double"


def winnow(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of one sequence of words (all its grams if fewer than a window)."""
    h = gram_hashes(words, list(range(GRAM)))
    if len(h) <= WINDOW:
        return np.arange(len(h)), h
    least = window_min(h, WINDOW)
    chosen = np.zeros(len(h), bool)
    for k in range(WINDOW):
        chosen[k:len(least) + k] |= h[k:len(least) + k] == least
    at = np.flatnonzero(chosen)
    return at, h[at]


def marks_of(templates: list[tuple[str, ...]]) -> list[list[np.ndarray]]:
    """Word hashes of the marks of each template; one without marks has none to meet."""
    out = []
    for t in templates:
        h, bounds, _ = word_hashes([m for x in t[2:] for m in x.split(";")], alnum)
        out.append([h[a:z] for a, z in zip(bounds, bounds[1:])])
    return out


def holds(words: np.ndarray, marks: list[np.ndarray]) -> bool:
    """Whether all marks stand in the words, one after another and each without gaps."""
    at = 0
    for mark in marks:
        n = len(words) - len(mark) + 1
        if n <= at:
            return False
        here = np.ones(n - at, bool)
        for k, word in enumerate(mark):
            here &= words[at + k:n + k] == word
        if not here.any():
            return False
        at += int(here.argmax()) + len(mark)
    return True


def build_index(templates: list[tuple[str, ...]]) -> tuple[list[np.ndarray], dict[int, list[tuple[int, int]]]]:
    """Words of the templates, and the inverted index fingerprint -> (template, place)."""
    h, bounds, _ = word_hashes([t[1] for t in templates], alnum)
    words = [h[a:z] for a, z in zip(bounds, bounds[1:])]
    index = defaultdict(list)
    for k, w in enumerate(words):
        for at, f in zip(*winnow(w)):
            index[int(f)].append((k, int(at)))
    return words, dict(index)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of template and text within ``band`` of ``shift``: words matched, first and last place in the text.

    Among equal scores the tightest span is taken, then the one nearest to ``shift``.
    """
    # row[k]: (matched, first, last) for text place i + shift - band + k; a later first place is the tighter one
    width = 2 * band + 1
    row = [(0, 0, -1)] * (width + 1)
    for i, word in enumerate(template):
        new = [(0, 0, -1)] * (width + 1)
        left = (0, 0, -1)
        for k in range(width):
            j = i + shift - band + k
            best = max(left, row[k + 1], key=lambda s: s[:2])
            if 0 <= j < len(text) and text[j] == word:
                m, first, _ = row[k]
                taken = (m + 1, first if m else j, j)
                best = max(best, taken, key=lambda s: s[:2])
            new[k] = left = best
        row = new
    return max(row, key=lambda s: (s[0], s[1] - s[2], -abs(s[1] - shift)))


def scan(words: np.ndarray, templates: list[np.ndarray], index: dict[int, list[tuple[int, int]]], known: np.ndarray, min_cover: int,
         marks: list[list[np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """``(template, matched, first word, last word)`` of the reported matches in one sequence of words."""
    at, f = winnow(words)
    near = defaultdict(list)
    for i in np.flatnonzero(np.isin(f, known)):
        for k, p in index[int(f[i])]:
            near[k].append(int(at[i]) - p)
    found = []
    for k, shifts in near.items():
        shifts.sort()
        cuts = [0] + [i for i in range(1, len(shifts)) if shifts[i] - shifts[i - 1] > BAND] + [len(shifts)]
        for a, z in zip(cuts, cuts[1:]):
            # The stretch that any of these alignments can reach; without the marks none counts.
            if not holds(words[max(shifts[a] - BAND, 0):max(shifts[z - 1] + BAND + len(templates[k]), 0)], marks[k]):
                continue
            for shift in dict.fromkeys(shifts[a:z]):
                m, first, last = align(templates[k], words, shift)
                if 100 * m >= min_cover * len(templates[k]) and holds(words[first:last + 1], marks[k]):
                    found.append((m, last - first + 1, k, first, last))
    kept = []
    for m, _, k, first, last in sorted(found, key=lambda x: (-x[0], x[1], -x[0] / len(templates[x[2]]), x[3], x[2])):
        if not any(first <= z and last >= a for _, _, a, z in kept):
            kept.append((k, m, first, last))
    return sorted(kept, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, ...]] = TEMPLATES, min_cover: int = MIN_COVER) -> DataFrame:
    """``ROWS``: one row per match; ``coverage_percent`` of the template's words, ``similarity`` matched words over the words of the span."""
    small_batches(docs.sparkSession)
    words, index = build_index(templates)
    marks = marks_of(templates)
    known = np.array(sorted(index), np.uint64)
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(ROWS.split(", "), types)])

    def run(batches):
        for b in batches:
            texts, ids, out = b.column("text").to_pylist(), b.column("doc_id").to_pylist(), []
            for s, e in slabs([len(t) for t in texts]):
                h, bounds, place = word_hashes(texts[s:e], alnum)
                # One look at all grams of the slab tells which texts can have a fingerprint at all.
                doc = np.repeat(np.arange(e - s), np.diff(bounds))
                for i in np.unique(doc[np.flatnonzero(np.isin(gram_hashes(h, list(range(GRAM))), known))]):
                    own = slice(bounds[i], bounds[i + 1])
                    found = scan(h[own], words, index, known, min_cover, marks)
                    if found:
                        spans = [m.span() for m in _WORD.finditer(texts[s + i])]
                        at = place[own]
                        for k, m, first, last in found:
                            n = len(words[k])
                            out.append((ids[s + i], templates[k][0], k, m, n, 100 * m // n, spans[at[first]][0], spans[at[last]][1], m / (last - first + 1)))
            yield out_batch(schema, list(zip(*out)) if out else [[]] * len(types))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ROWS)


def op7_winnowed_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole document, with coverage and spans."""
    return scan_licenses(table(spark, sf_dir, "documents"))
