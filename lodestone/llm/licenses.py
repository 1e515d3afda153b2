"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them.

A template of n shingles, STEP < n <= 2 * STEP for a power of two, is looked for in windows of three blocks of STEP shingles, one at each block, so each run of
2 * STEP shingles lies whole in some window. A window that holds the share c = LEAST of the template has Jaccard similarity c n / (3 STEP + (1 - c) n) >= c / (4 - c) = 0.25
with it (block ends add at most that), so with BANDS bands of one row each the chance to miss it is 0.75 ** BANDS, 1e-6. A window that meets
a template in a band is compared shingle by shingle.

Texts and templates are read alike (see shingles). A template of fewer than five words is one shingle and matches only a text that has no other word.

Cases: null and empty texts match nothing; rows that repeat a key are scanned each; null keys stay; an empty table gives an empty result; other columns
are not read. The longest document is read whole; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._base import lean, picked, prepared
from lodestone.llm.shingles import placed, text_slices

LEAST, BANDS = 0.8, 48
_MULTIPLY = np.random.default_rng(9).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: License notices and texts, by name.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-conditions": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def shingles_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(placed(data, np.array([0, len(data)]))[1])


def banded(shingle: np.ndarray, k: int) -> np.ndarray:
    return ((shingle * _MULTIPLY[k]) >> np.uint64(32)).astype(np.uint32)


class Index:
    """The templates' shingles and bands, by STEP."""

    def __init__(self, templates: dict[str, str]):
        self.names = [n for n, t in templates.items() if len(shingles_of(t))]
        self.shingles = [shingles_of(templates[n]) for n in self.names]
        self.steps: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            step = 1
            while 2 * step < len(s):
                step *= 2
            self.steps.setdefault(step, []).append(i)
        self.least = {s: np.array([[banded(self.shingles[i], k).min() for i in own] for k in range(BANDS)], np.uint32) for s, own in self.steps.items()}
        self.maybe = {}
        for s, least in self.least.items():
            self.maybe[s] = np.zeros((BANDS, 1 << 16), bool)
            for k in range(BANDS):
                self.maybe[s][k, least[k] & 0xFFFF] = True

    def search(self, doc: np.ndarray, shingle: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(template, share of it, first and last matching shingle) for each window that holds LEAST of a template."""
        if not len(doc):
            return
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(new, len(doc)))
        shape = {}
        for s in self.steps:
            blocks = -(-size // s)
            of = np.repeat(np.arange(len(new)), blocks)
            at = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            last = np.repeat(np.cumsum(blocks) - 1, blocks)
            i = np.arange(len(of))
            shape[s] = new[of] + at * s, np.minimum(i + 1, last), np.minimum(i + 2, last), np.minimum(new[of] + size[of], new[of] + (at + 3) * s)
        found: set[tuple[int, int, int]] = set()
        for k in range(BANDS):
            value = banded(shingle, k)
            for s, own in self.steps.items():
                begin, second, third, _ = shape[s]
                least = value if s == 1 else np.minimum.reduceat(value, begin)
                least = np.minimum(np.minimum(least, least[second]), least[third])
                for w in np.flatnonzero(self.maybe[s][k][least & np.uint32(0xFFFF)]).tolist():
                    found.update((s, w, own[t]) for t in np.flatnonzero(self.least[s][k] == least[w]).tolist())
        for s, w, t in sorted(found):
            begin, _, _, end = shape[s]
            at = np.flatnonzero(np.isin(shingle[begin[w] : end[w]], self.shingles[t]))
            share = len(np.unique(shingle[begin[w] : end[w]][at])) / len(self.shingles[t])
            if share >= LEAST:
                yield t, share, int(begin[w] + at[0]), int(begin[w] + at[-1])


_indexes: dict[tuple, Index] = {}


def _scanning(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if templates not in _indexes:
            _indexes[templates] = Index(dict(templates))
        index = _indexes[templates]
        for batch in batches:
            rows, out = [], []
            for a, _, data, offsets in text_slices(batch.column("text")):
                doc, shingle, begin, end = placed(data, offsets)
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for t, share, first, last in index.search(doc, shingle):
                    own, span = (int(doc[first]), t), (share, int(begin[first]), int(end[last]))
                    if own not in best or (-share, span[1], span[2]) < (-best[own][0], *best[own][1:]):
                        best[own] = span
                for (d, t), (share, x, y) in best.items():
                    ahead = data[offsets[d] : y]
                    points = np.cumsum((ahead & 0xC0) != 0x80)  # code points up to each byte
                    x -= offsets[d]
                    rows.append(a + d)
                    out.append((index.names[t], share, int(points[x - 1]) if x else 0, int(points[-1])))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = pa.string(), pa.float64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", "license", "containment", "start", "end"])

    return run


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document and license found in it: key, license, containment (best window's), start and end (code points from the first to the last matching shingle there)."""
    prepared(docs.sparkSession)
    rows = picked(docs, key=key, text=text)
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return rows.mapInArrow(lean(_scanning(tuple((templates or TEMPLATES).items()))), schema)
