"""Words and their hashes, shared by the operators that compare word sequences.

A word is a maximal run of characters other than space and the controls U+0009 to
U+000D, which is what ``bytes.split`` yields on UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
_KEPT_WORDS = 100_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """64-bit hashes of words; forgets all words when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def each_text(column: pa.Array) -> Iterator[bytes | None]:
    """The texts one after the other, so that not all of a batch are copied at once."""
    return (text.as_py() for text in column)


def lower_ascii(text: bytes) -> bytes:
    """The letters A to Z in lower case, all else as it is."""
    return text.translate(_LOWER)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``size`` words.

    Fewer words than that count as one run; no words give an empty set.
    """
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count])
    return np.unique(out)


class Rolling:
    """Rabin-Karp hashes, modulo 2**64, of every window of a sequence of word hashes."""

    def __init__(self, window: int, base: int):
        self.window, self.base = window, base
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        def powers(base: int) -> np.ndarray:
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        size = max(size, 2 * len(self.powers))
        self.powers, self.inverse = powers(self.base), powers(pow(self.base, -1, 2**64))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        count = len(hashes) - self.window + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        if len(self.powers) < len(hashes):
            self._grow(len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=sums[1:])
        return (sums[self.window :] - sums[:count]) * self.inverse[:count]


def runs(starts: Iterable[int], width: int) -> list[tuple[int, int]]:
    """Merge intervals of one width, given by ascending starts, into maximal ones."""
    merged: list[tuple[int, int]] = []
    for start in starts:
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], start + width)
        else:
            merged.append((start, start + width))
    return merged
