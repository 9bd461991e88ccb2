"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template of m five-word shingles belongs to the class c, the least power of two that isn't below m. A text's shingles are
covered by windows of 2 c, each c after the last, so every occurrence lies whole in a window. A window and a template each
have the least value of their shingles under BANDS permutations; one equal value retrieves the template, and nothing else does. At
a containment of PERCENT, the Jaccard similarity of window and template is at least `least_similarity()`, so a match is missed with a
probability of (1 - least_similarity()) ** BANDS, 3e-6. Then the share of the template's shingles that the window holds is
computed exactly. Least values of short blocks are computed once and joined to those of longer windows.

Templates are an argument: a frame with license and text, or a dict; the default is TEMPLATES, the scope of the query. They are
broadcast after their bytes are checked against TEMPLATE_BYTES.

Defined results: null, empty and short texts (under five words) hold no template, and templates of under five words are found nowhere; of several
windows that hold a template the one with the highest containment is reported, the first on ties; repeated rows give repeated
rows; an empty table or no templates give an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import SHINGLE, U, mix, shingle_list, word_hashes

PERCENT = 75
BANDS = 64
#: Templates of more bytes in all are refused.
TEMPLATE_BYTES = 16 << 20
#: Shingles that are hashed at once, a power of two.
PART = 1 << 12

# Texts and notices of common licenses, as their stewards publish them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
}

#: Bytes between words: ASCII that is neither letter nor digit.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F))
_KEYS = _SEEDS.astype(np.uint32)
_FACTORS = mix(_SEEDS).astype(np.uint32) | np.uint32(1)
#: High bits of a least value that a band's table of templates is looked up by.
_TABLE_BITS = 14
_SHIFT = np.uint32(32 - _TABLE_BITS)
_OF_BAND = np.arange(BANDS, dtype=np.uint32) << np.uint32(_TABLE_BITS)


def least_similarity(percent: int = PERCENT) -> float:
    """The least Jaccard similarity of a window of 2 c shingles and a template of m in (c / 2, c] that it holds to percent."""
    p = percent / 100
    return (p / 2) / (2 + (1 - p) / 2)


def permuted(shingles: np.ndarray) -> np.ndarray:
    """A row for each shingle (hashes already): its low half under each permutation."""
    out = shingles.astype(np.uint32)[:, None] ^ _KEYS
    out *= _FACTORS
    return out


def least_values(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each permutation."""
    return permuted(shingles).min(axis=0)


def halved(minima: np.ndarray) -> np.ndarray:
    """Least values of blocks of twice the size: two rows make one, an odd last one stays."""
    even = len(minima) // 2 * 2
    two = np.minimum(minima[:even:2], minima[1:even:2])
    return two if even == len(minima) else np.concatenate([two, minima[-1:]])


def block_minima(s: np.ndarray, size: int) -> np.ndarray:
    """Least values under each permutation of the blocks of `size` shingles (a power of two), the last of which may be shorter."""
    parts, step = [], max(size, PART)
    for k in range(0, len(s), step):
        part, at = permuted(s[k : k + step]), 1
        while at < size:
            part, at = halved(part), 2 * at
        parts.append(part)
    return np.concatenate(parts)


class Scanner:
    def __init__(self, templates: list[tuple[str, int, str]], percent: int = PERCENT):
        self.percent, self.names, self.sets = percent, [], []
        for name, k, text in templates:
            words = word_hashes(text, _BETWEEN)
            if len(words) >= SHINGLE:
                self.names.append((name, k))
                self.sets.append(np.unique(shingle_list(words)))
        self.classes: dict[int, tuple[dict[tuple[int, int], list[int]], np.ndarray]] = {}
        for i, s in enumerate(self.sets):
            keys, table = self.classes.setdefault(1 << (len(s) - 1).bit_length(), (defaultdict(list), np.zeros(BANDS << _TABLE_BITS, dtype=bool)))
            least = least_values(s)
            table[(least >> _SHIFT) + _OF_BAND] = True
            for key in enumerate(least.tolist()):
                keys[key].append(i)

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """(license, template, containment, first word, end word) for the templates that the text holds."""
        words = word_hashes(text or "", _BETWEEN)
        if len(words) < SHINGLE or not self.sets:
            return []
        s = shingle_list(words)
        best: dict[int, tuple[float, int, int]] = {}
        minima, at = None, 0
        for c in sorted(self.classes):
            if minima is None:
                minima, at = block_minima(s, c), c
            while at < c:
                minima, at = halved(minima), 2 * at
            windows = np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima
            keys, table = self.classes[c]
            met = np.flatnonzero(table[(windows >> _SHIFT) + _OF_BAND])
            places, values = np.divmod(met, BANDS), windows.reshape(-1)[met].tolist()
            found = {(k, i) for k, band, value in zip(places[0].tolist(), places[1].tolist(), values, strict=True) for i in keys.get((band, value), ())}
            for k, i in sorted(found):
                window = s[k * c : (k + 2) * c]
                own = np.isin(window, self.sets[i])
                share = len(np.unique(window[own])) / len(self.sets[i])
                if 100 * share >= self.percent and share > best.get(i, (0.0,))[0]:
                    held = np.flatnonzero(own)
                    best[i] = (share, int(k * c + held[0]), int(k * c + held[-1] + SHINGLE))
        return [(*self.names[i], *best[i]) for i in sorted(best)]


def template_rows(templates: DataFrame | dict[str, list[str]] | None) -> list[tuple[str, int, str]]:
    """(license, number in it, text) of the templates, in order; a frame that holds too much is refused before it's read."""
    if isinstance(templates, DataFrame):
        own = templates.filter(F.col("license").isNotNull() & F.col("text").isNotNull()).select(F.col("license").cast("string"), F.col("text").cast("string")).distinct()
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"{size} bytes of templates are more than {TEMPLATE_BYTES}")
        texts: dict[str, list[str]] = {}
        for r in own.orderBy("license", "text").collect():
            texts.setdefault(r["license"], []).append(r["text"])
        templates = texts
    return [(name, k, t) for name, texts in (TEMPLATES if templates is None else templates).items() for k, t in enumerate(texts)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, template, containment, first_word, end_word: a row for each template that a document holds."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    names = ["doc_id", "license", "template", "containment", "first_word", "end_word"]
    shared = docs.sparkSession.sparkContext.broadcast(template_rows(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(shared.value, percent)
        for batch in batches:
            rows = [(i, *m) for i, text in enumerate(batch.column("text")) for m in own.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            arrays[0] = batch.column("doc_id").take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, license string, template int, containment double, first_word long, end_word long")
