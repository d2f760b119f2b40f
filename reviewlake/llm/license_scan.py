"""Operator 10: licence notices by MinHash bands over overlapping windows.

Templates fall into length classes.  For each class all texts are covered by overlapping windows of a
length that holds any template of the class, and every window has `bands` MinHash values of its
five-word shingles.  A window that shares a band with a template retrieves it; containment of the
template's distinct shingles in the window is then counted exactly.

A window of class j (templates of 2^j to 2^(j+1) - 1 shingles) has 2^(j+1) + 2^(j-1) shingles and a new
one begins every 2^(j-1).  Where a template is contained to at least 0.8, the similarity of some window
with it is at least 0.8 / 2.7, so that 64 one-row bands retrieve it with a probability above 1 - 2e-10.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

SHINGLE, BANDS, CONTAINED = 5, 64, 0.8
_BYTES = 1 << 19

#: Public notices by licence.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl-2.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl-2.1": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "lgpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five-word shingle hashes, their bounds and the word counts of each text; a text of fewer words
    has none."""
    lowered = tb.LOWER[data]
    starts, ends, bounds = tb.word_spans(lowered, offsets, tb.ALNUM)
    words = np.diff(bounds)
    hashes, spans = tb.shingle_hashes(tb.span_hashes(lowered, starts, ends), bounds, SHINGLE)
    short = np.repeat(words < SHINGLE, np.diff(spans))
    hashes = hashes[~short]
    return hashes, np.concatenate(([0], np.cumsum(np.maximum(words - SHINGLE + 1, 0)))), words


class Templates:
    """Distinct shingles and MinHash bands of each template, by length class."""

    def __init__(self, templates: dict[str, list[str]], bands: int, contained: float):
        self.multipliers = tb.mix64(np.arange(2000, 2000 + bands, dtype=np.uint64)) | np.uint64(1)
        self.contained = contained
        self.names, self.sets = [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                shingles = np.unique(text_shingles(raw, np.array([0, len(raw)]))[0])
                if not len(shingles):
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                self.names.append(name)
                self.sets.append(shingles)
        self.classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            self.classes.setdefault(int(len(s)).bit_length() - 1, []).append(t)
        # distinct band values of each class
        self.minima = [[int(_hash(s, m).min()) for s in self.sets] for m in self.multipliers]


def _hash(shingles: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((shingles * multiplier) >> np.uint64(32)).astype(np.uint32)


def retrieved(hashes: np.ndarray, templates: Templates) -> dict[int, np.ndarray]:
    """First shingles of the windows that share a band with each template."""
    n = len(hashes)
    out: dict[int, list[np.ndarray]] = {}
    top = max(templates.classes)
    for k, multiplier in enumerate(templates.multipliers):
        # window minima of lengths 1, 2, 4, ... at every place, padded at the end
        minima = _hash(hashes, multiplier)
        half = minima
        for j in range(top + 2):
            # `minima` spans 2^j shingles, `half` 2^(j-1)
            if j and j - 1 in templates.classes:
                step = max(1, 1 << max(0, j - 2)) if j >= 2 else 1
                wide = minima[::step]
                if j >= 2:  # 2^j + 2^(j-2) shingles: the last quarter is another short window
                    late = np.full(len(minima), 0xFFFFFFFF, dtype=np.uint32)
                    shift = (1 << j) + (1 << (j - 2)) - (1 << (j - 1))
                    late[:max(0, n - shift)] = half[min(n, shift):]
                    wide = np.minimum(minima, late)[::step]
                for t in templates.classes[j - 1]:
                    at = np.flatnonzero(wide == templates.minima[k][t])
                    if len(at):
                        out.setdefault(t, []).append(at * step)
            longer = minima.copy()
            reach = 1 << j
            if reach < n:
                np.minimum(minima[:n - reach], minima[reach:], out=longer[:n - reach])
            half, minima = minima, longer
    return {t: np.unique(np.concatenate(found)) for t, found in out.items()}


def scan(data: np.ndarray, offsets: np.ndarray, templates: Templates) -> tuple[np.ndarray, list[tuple[int, str, int, int, float]]]:
    """Word counts, and matches (text, licence, first word, end word, containment).

    Windows that hold a template to the least containment and overlap are one match, from its first to
    its last shingle that is the template's.
    """
    hashes, bounds, words = text_shingles(data, offsets)
    matches = []
    if len(hashes):
        for t, firsts in retrieved(hashes, templates).items():
            own = templates.sets[t]
            width = 1 << int(len(own)).bit_length()
            width += width // 4
            # a window that reaches into further texts is a window of each, cut at their ends
            one = np.searchsorted(bounds, firsts, side="right") - 1
            many = np.searchsorted(bounds, np.minimum(firsts + width, len(hashes)) - 1, side="right") - one
            doc = np.repeat(one - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            ends = np.minimum(np.repeat(firsts + width, many), bounds[doc + 1])
            firsts = np.maximum(np.repeat(firsts, many), bounds[doc])
            order = np.lexsort((firsts, doc))
            doc, firsts, ends = doc[order], firsts[order], ends[order]
            at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
            place = np.flatnonzero(own[at] == hashes)
            lo, hi = np.searchsorted(place, firsts), np.searchsorted(place, ends)
            last: tuple | None = None
            for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()):
                inside = place[a:b]
                share = len(np.unique(at[inside])) / len(own)
                if share < templates.contained:
                    continue
                first, end = int(inside[0] - bounds[d]), int(inside[-1] - bounds[d]) + SHINGLE
                if last is not None and last[0] == d and first < last[3]:
                    last = (d, templates.names[t], last[2], max(last[3], end), max(last[4], share))
                    matches[-1] = last
                else:
                    last = (d, templates.names[t], first, end, share)
                    matches.append(last)
    return words, matches


def nearest(matches: list[tuple[int, str, int, int, float]]) -> list[tuple[int, str, int, int, float]]:
    """The matches of one text without those that another licence's match of higher containment overlaps by
    more than half of the shorter span: notices of sibling licences differ in a few words only."""
    kept: list[tuple[int, str, int, int, float]] = []
    for m in sorted(matches, key=lambda m: (-m[4], m[1], m[2], m[3])):
        if not any(k[1] != m[1] and k[4] > m[4] and 2 * (min(k[3], m[3]) - max(k[2], m[2])) > min(k[3] - k[2], m[3] - m[2]) for k in kept):
            kept.append(m)
    return kept


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None,
                   bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_matches, licenses, best, spans of every row.

    licenses: the distinct licence names found, sorted and comma-joined (empty: none); n_matches: spans
    found; spans: name:first word:end word, sorted and comma-joined; best: the highest containment (0:
    none).  Of spans of several licences that overlap, the ones of the highest containment count.  Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters.

    Null and empty texts have no words; texts of fewer than five words no matches.  Rows are independent:
    repeated rows and null ids are returned as they come; an empty table gives no rows; other columns are
    not read.  Templates need five words each.
    """
    known = Templates(TEMPLATES if templates is None else templates, bands, contained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(1), _BYTES):
                words, matches = scan(data, offsets, known)
                found: list[list[tuple]] = [[] for _ in range(end - first)]
                for m in set(matches):
                    found[m[0]].append(m)
                found = [nearest(f) if len(f) > 1 else f for f in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), pa.array(words, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({m[1] for m in f})) for f in found], pa.string()),
                    pa.array([max((m[4] for m in f), default=0.0) for f in found], pa.float64()),
                    pa.array([",".join(f"{m[1]}:{m[2]}:{m[3]}" for m in sorted(f, key=lambda m: (m[1], m[2], m[3]))) for f in found], pa.string()),
                ], ["doc_id", "n_words", "n_matches", "licenses", "best", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_matches long, licenses string, best double, spans string")
