"""Array helpers on the UTF-8 bytes of a batch of texts: words, segment hashes, windows.

All functions take whole texts. A batch is cut between texts into chunks of about
``CHUNK`` bytes so that a task's memory depends on its longest text, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


# fixed values: the separators of the two word rules, as byte ranges
LETTER_DIGIT_WORD = _byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACE_WORD = _byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of texts; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary())
    n = len(arr)
    if n == 0:
        return
    _, offset_buffer, data = arr.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, count=n + 1, offset=8 * arr.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of a public-domain 64-bit hash)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_BYTE_VALUES = (seeds(256, 7), seeds(256, 8))


@lru_cache(maxsize=4)
def _powers(bits: int, inverse: bool, kind: int) -> np.ndarray:
    base = pow(_BASES[kind], -1, 1 << 64) if inverse else _BASES[kind]
    steps = np.full(1 << bits, base, U64)
    steps[0] = 1
    return np.cumprod(steps, dtype=U64)


def powers(n: int, inverse: bool = False, kind: int = 0) -> np.ndarray:
    return _powers(max(20, int(n).bit_length()), inverse, kind)[: n + 1]


class SegmentHash:
    """Hashes of any byte ranges of one buffer, from one running sum; two independent kinds."""

    def __init__(self, buf: np.ndarray, kind: int = 0):
        n = len(buf)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[kind][buf] * powers(n, kind=kind)[:n], out=self.sums[1:])
        self.inverse = powers(n, True, kind)

    def runs(self, low: int, high: int, size: int) -> np.ndarray:
        """Hashes of the ranges [i, i + size) for i from ``low`` to before ``high``."""
        return mix((self.sums[low + size : high + size] - self.sums[low:high]) * self.inverse[low:high])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def words(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text plus the total) of maximal runs of word bytes."""
    inside = word_bytes[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    if len(buf):
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (of the whole array; mask text borders outside)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j, factor in enumerate(seeds(size, 11) | U64(1)):
        total += values[j : j + n] * factor
    return mix(total)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every line that has a byte; lines end at a line feed or with the text."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(buf)]
    if not len(starts):
        return starts, starts, starts
    bound = np.concatenate([starts[1:], [len(buf)]])
    ends = np.where(buf[bound - 1] == 10, bound - 1, bound)
    text = np.searchsorted(offsets, starts, "right") - 1
    some = ends > starts
    return starts[some], ends[some], text[some]
