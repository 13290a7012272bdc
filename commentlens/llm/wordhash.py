"""Word and shingle hashes of whole texts, computed over Arrow buffers inside a task.

A word is a run of bytes outside space and 0x09 to 0x0D. Texts are handled in slices of about
``SLICE_BYTES``, so memory does not follow the size of an Arrow batch, and a text longer than a
slice is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: The word separators of the contracts, as a Java, Python and SQL character class.
SPACE = r"[\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, length: int) -> np.ndarray:
    """base^0 .. base^(length - 1) modulo 2^64."""
    table = _powers.get(base)
    if table is None or len(table) < length:
        table = np.full(max(length, SLICE_BYTES + 4096), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[base] = table
    return table[:length]


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte range, by differences of prefix sums."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
        piece = data[low:int(ends[last - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        # one is added to each byte, as a zero byte would leave a sum unchanged
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(piece)), out=sums[1:])
        begin, end = starts[first:last] - low, ends[first:last] - low
        value = (sums[end] - sums[begin]) * _power(_BASE_INVERSE, len(piece))[begin]
        out[first:last] = mix64(value + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


@dataclass
class Slice:
    """Consecutive texts of a batch and their words.

    Words of text ``i`` are ``first[i]`` up to ``first[i + 1]``; ``starts`` and ``ends`` are their
    byte ranges in ``data``. ``row`` is the number of the first text in its batch.
    """

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def words(self, text: int) -> list[bytes]:
        low, high = self.first[text], self.first[text + 1]
        raw = self.data
        return [raw[a:b].tobytes() for a, b in zip(self.starts[low:high], self.ends[low:high], strict=True)]


def slices(texts: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """Slices of a string array; a null text has no words. ``lower`` folds A-Z only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, "right")) - 1)
        yield _slice(raw[bounds[row]:bounds[stop]], bounds[row:stop + 1] - bounds[row], row, lower)
        row = stop


def _slice(data: np.ndarray, bounds: np.ndarray, row: int, lower: bool) -> Slice:
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SPACE[data]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Slice(row, data, starts, ends, np.searchsorted(starts, bounds), _hash_words(data, starts, ends))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; empty if there are fewer."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k:k + count]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix64(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` make one shingle, none make none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(grams(words, min(size, len(words))))
