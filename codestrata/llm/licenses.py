"""License scans by MinHash bands over overlapping text windows (operator 6).

Templates are split into classes by their number of five-word shingles, each
class twice as wide as the one before. For a class of up to m shingles a text is
read in windows of 2 m shingles, m apart, so every occurrence lies wholly in one
window. A window that holds 80 % of a template of more than m / 2 shingles has
similarity 0.18 or more with it; over BANDS bands of one row each it is missed
with probability (1 - 0.18)**BANDS < 1e-6 (BANDS = 72). Each candidate is then
verified by exact containment of the template's shingles in the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, blocks, mix
from .shared import bounded

SHINGLE = 5
BANDS = 72
CONTAINED = 80

#: Notices of public licenses, as their stewards word them.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
        " in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "mit-line": "Released under the MIT License.",
}

FOUND = "doc_id long, template string, n_matched long, n_shingles long, first_word long"

_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(text: str) -> np.ndarray:
    w = Words([text.encode()], fold=True, letters=True)
    at = np.arange(len(w) - SHINGLE + 1)
    return np.unique(w.ranges(at, at + SHINGLE))


class Templates:
    """Templates by class, with their band values."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets = [_shingles(texts[n]) for n in self.names]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        self.least = [[int((mix(s ^ salt)).min()) for salt in _SALTS] for s in self.sets]

    def scan(self, w: Words, h: np.ndarray, valid: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, template, first word, matched) of every verified window. h: shingle hash at each word, where valid."""
        places = np.flatnonzero(valid)
        if not len(places):
            return
        doc, rank = w.text[places], places - w.first[w.text[places]]
        value = h[places]
        edges = {m: np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rank[1:] // m != rank[:-1] // m)]) for m in self.classes}
        hits: set[tuple[int, int, int]] = set()
        for band, salt in enumerate(_SALTS):
            x = mix(value ^ salt)
            for m, members in self.classes.items():
                half = np.minimum.reduceat(x, edges[m])
                owner = doc[edges[m]]
                both = half.copy()
                both[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(half[:-1], half[1:]), half[:-1])
                for t in members:
                    hits.update((m, int(k), t) for k in np.flatnonzero(both == np.uint64(self.least[t][band])))
        for m, k, t in hits:
            begin = edges[m][k]
            stop = edges[m][k + 1] if k + 1 < len(edges[m]) else len(places)
            if k + 1 < len(edges[m]) and doc[edges[m][k + 1]] == doc[begin]:
                stop = edges[m][k + 2] if k + 2 < len(edges[m]) else len(places)
            own = np.isin(value[begin:stop], self.sets[t])
            matched = np.unique(value[begin:stop][own])
            if 100 * len(matched) >= CONTAINED * len(self.sets[t]):
                yield int(doc[begin]), t, int(rank[begin + int(own.argmax())]), matched


def _scan(batches: Iterator[pa.RecordBatch], texts: dict[str, str]) -> Iterator[pa.RecordBatch]:
    templates = Templates(texts)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for begin, held in blocks(batch.column(1).to_pylist()):
            w = Words(held, fold=True, letters=True)
            n = len(w)
            if n < SHINGLE:
                continue
            at = np.arange(n - SHINGLE + 1)
            h = np.zeros(n, np.uint64)
            h[: len(at)] = w.ranges(at, at + SHINGLE)
            valid = np.zeros(n, bool)
            valid[: len(at)] = w.text[: len(at)] == w.text[SHINGLE - 1 :]
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for doc, t, first, matched in templates.scan(w, h, valid):
                held_best = best.get((doc, t), (0, 0))
                best[doc, t] = max(held_best, (len(matched), -first))
            rows += [(ids[begin + doc], templates.names[t], n_matched, len(templates.sets[t]), -first) for (doc, t), (n_matched, first) in sorted(best.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found in it: doc_id, template, n_matched, n_shingles, containment, first_word.

    Words are runs of ASCII letters, digits and bytes over 127, A-Z folded. A
    template is found where a window holds at least 80 % of its shingles; the
    fullest such window counts, of equals the first; first_word is the number
    of its first shared shingle's first word.

    Null or empty texts hold nothing; texts of any length are scanned whole. Repeated rows each give their rows, as do
    null ids. Other columns are ignored. No rows give no rows.
    """
    texts = TEMPLATES if templates is None else templates
    bounded(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = base.mapInArrow(lambda it: _scan(it, texts), FOUND)
    return found.select("doc_id", "template", "n_matched", "n_shingles", (F.col("n_matched") / F.col("n_shingles")).alias("containment"), "first_word")
