"""License notices in whole texts, by MinHash over windows and exact containment.

Method. A text is a sequence of words (runs of ASCII letters, digits and
non-ASCII bytes, ASCII lower-cased) and of its shingles of
``min(5, words of the template)`` words. For templates of one size class
(shingle length, number of shingles rounded up to a power of two, L) the text is
cut into windows of 2 L shingles, every L shingles from its beginning. A window's
MinHash signature, in bands of ``ROWS`` values, retrieves the templates that share a
band. For a text and a template so retrieved, all places of the template's shingles in the
text are taken, without regard to windows. Places less than 2 L apart belong
together; from the first on, the places are taken until they hold a share of at
least 0.8 of the template's distinct shingles, those in front that come again are dropped,
and the places that follow are added until one repeats. That is a match; the next is sought behind it.

Guarantee: a text is missed only if no window of it shares a band with the template. A
window of 2 L shingles that holds a share of at least 0.8 of a
template of more than L / 2 shingles has a Jaccard similarity with it of at
least 0.8 (L / 2) / (2 L + 0.2 (L / 2)) > 0.19. With ROWS = 1 a band agrees with
that probability, so all of ``BANDS`` = 64 bands miss with a probability under
2e-6 (for a template of L shingles contained whole: 0.5 ** 64). A match that a border cuts or
that insertions stretch lies in several windows with smaller shares, each of which may retrieve it.

Scale: one pass without a shuffle; what is sent to the tasks is the list of
templates, a parameter. Texts are hashed about a megabyte at a time; a longer
text is hashed whole.

Rows: null and empty texts have no match; a text has a row for each
separate occurrence, whatever rows stand beside it; repeated rows are scanned each; a null doc_id is passed on;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import text_slices
from shopcast.llm.hashing import Joined, by_size, mixed, segments

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 64, 1

#: Notices as their licenses word them. Notices that differ in a few words match each other
#: too, with a lower containment.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
#: Names by which short notices call a license.
NAMES = {
    "AGPL": "GNU Affero General Public License", "Apache-2.0": "Apache License, Version 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License", "EPL": "Eclipse Public License", "GPL": "GNU General Public License", "ISC": "ISC License", "LGPL": "GNU Lesser General Public License",
    "MIT": "MIT License", "MPL": "Mozilla Public License", "Unlicense": "Unlicense License", "Zlib": "zlib License",
}
#: Parts of the Creative Commons names.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
           "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Identifiers of SPDX lines.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")


def _templates() -> dict[str, str]:
    """Notices, short forms of each name, Creative Commons sentences and SPDX lines; of equal wordings the first."""
    out = dict(NOTICES)
    out |= {f"CC-{k}-4.0-sentence": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in COMMONS.items()}
    out |= {f"CC-{k}-4.0-licensed": f"Licensed under CC {k} 4.0." for k in COMMONS}
    out |= {f"{k}-{form.split()[0].lower()}": f"{form} the {v}" for k, v in NAMES.items() for form in ("Licensed under", "Released under", "Distributed under", "Terms of")}
    out |= {f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in SPDX}
    seen: set = set()
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    return {k: t for k, t in out.items() if not ((w := tuple(words(t))) in seen or seen.add(w))}


TEMPLATES = _templates()

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(2**64 - 1)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Shingles:
    """Word shingles of joined texts; 0 where a shingle would reach into the next text."""

    def __init__(self, texts: list[str | None]):
        self.text = Joined(texts, _WORD)
        self.words = segments(_LOWER[self.text.raw], self.text.begin, self.text.end)

    def of(self, n: int) -> np.ndarray:
        h = np.zeros(max(0, len(self.words) - n + 1), np.uint64)
        for i in range(n):
            h = h * _MUL + self.words[i:len(h) + i]
        return np.where(self.text.doc[:len(h)] == self.text.doc[n - 1:len(h) + n - 1], mixed(h), np.uint64(0))


def _blocks(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each ``length`` values (a power of two)."""
    while length > 1:
        if len(values) % 2:
            values = np.append(values, _MOST)
        values, length = np.minimum(values[::2], values[1::2]), length // 2
    return values


def occurrences(at: np.ndarray, values: np.ndarray, size: int, threshold: float, gap: int) -> list[tuple[int, int, float]]:
    """First and last place, and share, of each occurrence of a template with ``size`` shingles, of which ``values`` stand at the places ``at``."""
    out, at, values = [], at.tolist(), values.tolist()
    held: Counter = Counter()
    lo, hi = 0, 0
    while hi < len(at):
        if hi > lo and at[hi] - at[hi - 1] >= gap:
            held.clear()
            lo = hi
        held[values[hi]] += 1
        hi += 1
        if len(held) / size < threshold:
            continue
        while held[values[lo]] > 1:
            held[values[lo]] -= 1
            lo += 1
        while hi < len(at) and at[hi] - at[hi - 1] < gap and values[hi] not in held:
            held[values[hi]] += 1
            hi += 1
        out.append((at[lo], at[hi - 1], len(held) / size))
        held.clear()
        lo = hi
    return out


class Library:
    """Templates by size class (shingle length, L), with a table of each band's keys."""

    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = draw.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 2**63, bands * rows, np.uint64)
        self.classes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name in sorted(templates):
            s = Shingles([templates[name]])
            if n := min(shingle, len(s.words)):
                self.classes.setdefault((n, 1 << (len(s.words) - n).bit_length()), []).append((name, np.unique(s.of(n))))
        #: Per class and band: key -> templates, and a bitmap of the keys' short forms, which rules out nearly all windows.
        self.index: dict[tuple[int, int, int], tuple[dict[int, list[int]], np.ndarray]] = {}
        for (n, length), held in self.classes.items():
            for b in range(bands):
                table: dict[int, list[int]] = {}
                for t, (_, own) in enumerate(held):
                    key = np.zeros(1, np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        key = key * _MUL + (own * self.mul[r] + self.add[r]).min()
                    table.setdefault(int(key[0]), []).append(t)
                hot = np.zeros(1 << 16, bool)
                hot[self._short(np.array(list(table), np.uint64))] = True
                self.index[n, length, b] = table, hot

    @staticmethod
    def _short(keys: np.ndarray) -> np.ndarray:
        return (keys * _MUL) >> np.uint64(48)

    def candidates(self, shingles: np.ndarray, n: int) -> set[tuple[int, int, int]]:
        """(L, window, template) of windows that share a band with a template of shingle length ``n``."""
        lengths = sorted(length for m, length in self.classes if m == n)
        found = set()
        for b in range(self.bands):
            keys: dict[int, np.ndarray] = {}
            for r in range(b * self.rows, (b + 1) * self.rows):
                least, at = shingles * self.mul[r] + self.add[r], 1
                for length in lengths:
                    least, at = _blocks(least, length // at), length
                    window = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                    keys[length] = window if r == b * self.rows else keys[length] * _MUL + window
            for length in lengths:
                table, hot = self.index[n, length, b]
                for w in np.flatnonzero(hot[self._short(keys[length])]).tolist():
                    found.update((length, w, t) for t in table.get(int(keys[length][w]), ()))
        return found

    def windows(self, shingles: np.ndarray, n: int) -> set[tuple[int, int, int]]:
        """All (L, window, template), for comparison with ``candidates``."""
        return {(length, w, t) for (m, length), held in self.classes.items() if m == n for w in range(max(1, -(-len(shingles) // length) - 1)) for t in range(len(held))}

    def scan(self, texts: list[str | None], threshold: float = THRESHOLD, exhaustive: bool = False) -> list[tuple[int, str, float, int, int]]:
        """Matches (text's place, template, containment, begin, end in its UTF-8 bytes)."""
        s = Shingles(texts)
        t, found = s.text, []
        for n in sorted({n for n, _ in self.classes}):
            shingles = s.of(n)
            if not len(shingles):
                continue
            # Each text begins with a block of the largest class and is followed by an empty one.
            doc, block = t.doc[:len(shingles)], max(length for m, length in self.classes if m == n)
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            blocks = np.where(np.diff(first) > 0, -(-np.diff(first) // block) + 1, 0)
            begin = np.append(0, np.cumsum(blocks * block))
            spread = np.zeros(begin[-1], np.uint64)
            spread[np.arange(len(shingles)) + (begin - first)[doc]] = shingles
            pairs = set()
            for length, w, k in (self.windows if exhaustive else self.candidates)(spread, n):
                for at in (w * length, min((w + 1) * length, len(spread) - 1)):
                    pairs.add((int(np.searchsorted(begin, at, side="right")) - 1, length, k))
            for d, length, k in pairs:
                name, own = self.classes[n, length][k]
                at = np.flatnonzero(np.isin(shingles[first[d]:first[d + 1]], own)) + first[d]
                for i, j, share in occurrences(at, shingles[at], len(own), threshold, 2 * length):
                    found.append((d, name, share, int(t.begin[i] - t.start[d]), int(t.end[j + n - 1] - t.start[d])))
        return sorted(found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per match in ``docs`` (doc_id, text): doc_id, license, containment, begin_byte, end_byte."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        library = Library(templates, shingle, bands, rows)
        for b in text_slices(batches, 512):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            out = [(ids[i + d], *m) for i, j in by_size(texts) for d, *m in library.scan(texts[i:j], threshold)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "license", "containment", "begin_byte", "end_byte"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, containment double, begin_byte long, end_byte long")
