"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

An inverted index maps the fingerprints of all templates to their places. A document's
fingerprints that occur in it give candidate stretches, one per template and diagonal;
there the document's words are aligned with the template's in a band.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.words import Rolling, each_text, mixed

GRAM, WINNOW, BAND = 3, 2, 8
LEAST_COVERAGE = 0.8
MOST_TEMPLATE_WORDS = 1_000_000
_KEPT_WORDS = 100_000
_BASE = 0xD1342543DE82EF95
_VALUE = np.uint64(xxhash.xxh3_64_intdigest("<version>"))
Batches = Iterator[pa.RecordBatch]

# fixed values: public license notices, as they are written into works
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY line": "Licensed under CC BY 4.0.",
    "CC-BY-NC line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA line": "Licensed under CC BY-SA 4.0.",
    "GPL line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "BSD line": "Released under the BSD License.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


class _Words(dict):
    """Hash of a word's letters and digits in lower case; 0 if it has none, one for all versions."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        core = "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalnum())
        if not core:
            value = 0
        elif core.lstrip("v").isdigit():
            value = int(_VALUE)
        else:
            value = xxhash.xxh3_64_intdigest(core)
        self[word] = value
        return value

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words that have one, and their places among all words."""
        words = (text or b"").split()
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        places = np.flatnonzero(hashes)
        return hashes[places], places


def fingerprints(hashes: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the winnowed n-grams: the least of every few in a row."""
    grams = mixed(rolling.of(hashes))
    if len(grams) < WINNOW:
        return np.arange(len(grams)), grams
    views = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    places = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    return places, grams[places]


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment with doc place - template place near ``shift``.

    The longest common subsequence within the band; of equally long ones the shortest, of
    those the nearest to ``shift``, of those the first.
    """
    width = 2 * band + 1
    # column c of row q stands for the place q + shift - band + c of the document
    score = np.zeros(width + 1, np.int64)
    start = np.full(width + 1, -1, np.int64)
    best, away = (0, 0, -1), -width
    for q in range(len(template)):
        places = np.arange(width) + q + shift - band
        inside = (places >= 0) & (places < len(doc))
        equal = np.zeros(width, bool)
        equal[inside] = doc[places[inside]] == template[q]
        new, begin = np.zeros(width + 1, np.int64), np.full(width + 1, -1, np.int64)
        # without this template word, the cell above stands one column further right
        new[:width], begin[:width] = score[1:], start[1:]
        for c in np.flatnonzero(equal):
            if score[c] + 1 > new[c]:
                new[c] = score[c] + 1
                begin[c] = places[c] if score[c] == 0 else start[c]
                if (new[c], begin[c] - places[c], -abs(c - band)) > (best[0], best[1] - best[2], away):
                    best, away = (int(new[c]), int(begin[c]), int(places[c])), -abs(c - band)
        # without a word of the document, the best of the columns further left
        top = np.maximum.accumulate(new[:width])
        origin = np.where(new[:width] == top, np.arange(width), 0)
        origin = np.maximum.accumulate(origin)
        score = np.append(top, 0)
        start = np.append(begin[origin], -1)
    return best


def _covered(kept: list[tuple], place: int) -> bool:
    """Whether one of ascending matches (start, end, ...) holds a place."""
    after = bisect_right(kept, (place, float("inf")))
    return bool(after) and place < kept[after - 1][1]


def _diagonals(stretches: set[tuple[int, int, int]], band: int) -> list[tuple[int, int, int]]:
    """One (template, shift, place) of those that stand within half a band of each other.

    A template that comes again has a diagonal of its own, however near: its fingerprints
    stand at least a template's length, less the band, behind the first ones.
    """
    chosen: list[tuple[int, int, int]] = []
    for k, shift, place in sorted(stretches):
        if not chosen or chosen[-1][0] != k or shift > chosen[-1][1] + band // 2:
            chosen.append((k, shift, place))
    return chosen


def _near(
    hashes: np.ndarray, known: list[np.ndarray], kept: list[tuple], band: int, least: float, stretch: tuple[int, int, int]
) -> tuple[int, int, int, int] | None:
    """(matched words, start, end, template) at a stretch, between the matches beside it."""
    k, shift, place = stretch
    low, high = max(0, shift - band), max(0, shift + len(known[k]) + band)
    after = bisect_right(kept, (place, float("inf")))
    if after:
        low = max(low, kept[after - 1][1])
    if after < len(kept):
        high = min(high, kept[after][0])
    common, first, last = align(hashes[low:high], known[k], shift - low, band)
    if common < least * len(known[k]) or last - first + 1 > common / least:
        return None
    return common, low + first, low + last + 1, k


def _find(templates: Mapping[str, str], band: int, least: float) -> Callable[[Batches], Batches]:
    def find(batches: Batches) -> Batches:
        vocabulary, rolling = _Words(), Rolling(GRAM, _BASE)
        names = sorted(templates)
        known = [vocabulary.of(templates[n].encode())[0] for n in names]
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, hashes in enumerate(known):
            for place, value in zip(*(x.tolist() for x in fingerprints(hashes, rolling)), strict=True):
                index[value].append((k, place))
        prints = np.array(sorted(index), np.uint64)

        def matches(text: bytes | None) -> list[dict]:
            hashes, places = vocabulary.of(text)
            at, values = fingerprints(hashes, rolling)
            slot = np.searchsorted(prints, values)
            hit = np.flatnonzero(prints[np.minimum(slot, len(prints) - 1)] == values) if len(prints) else []
            stretches = {(k, int(at[i]) - place, int(at[i])) for i in hit for k, place in index[int(values[i])]}
            kept: list[tuple] = []  # places of matches, ascending and apart
            while stretches:
                found = {m for m in map(partial(_near, hashes, known, kept, band, least), _diagonals(stretches, band)) if m}
                # of overlapping matches the one with more matched words stays, then the closer one
                before = len(kept)
                for common, start, end, k in sorted(found, key=lambda m: (-m[0], -m[0] / len(known[m[3]]), m[1], m[3])):
                    place = bisect_left(kept, (start,))
                    if (not place or kept[place - 1][1] <= start) and (place == len(kept) or end <= kept[place][0]):
                        kept.insert(place, (start, end, k, common))
                if len(kept) == before:
                    break
                # what no match covers yet is looked at again, without what is covered
                stretches = {s for s in stretches if not _covered(kept, s[2])}
            return [
                dict(license=names[k], coverage=common / len(known[k]), start=int(places[s]), end=int(places[e - 1]) + 1)
                for s, e, k, common in kept
            ]

        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([matches(t) for t in each_text(batch["text"])], kind)], names=["doc_id", "matches"]
            )

    return find


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] | None = None, band: int = BAND, least: float = LEAST_COVERAGE
) -> DataFrame:
    """Every document row with the license notices in it.

    Returns ``doc_id`` and ``matches``, an array of ``license, coverage`` (matched share of
    the template's words) and ``start, end`` (word places, end exclusive) in order of place.

    Words are compared by their letters and digits in lower case, and version numbers are
    all equal. A match has ``least`` of the template's words in order, at most ``band`` words
    off the diagonal, and as large a share of the words between its ends. It is found if
    four words in a row agree somewhere. Of overlapping matches the one with the most
    matched words stays; what it leaves uncovered is looked at again, so that notices side
    by side are all found. Null and empty texts match nothing; rows that repeat an id, or have
    none, are scanned one by one; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.split()) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MOST_TEMPLATE_WORDS} words; scan them in parts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(
        _find(dict(templates), band, least),
        "doc_id long, matches array<struct<license:string,coverage:double,start:long,end:long>>",
    )
