"""Texts of an Arrow batch as one byte array: splitting into words and hashing them without per-word Python.

UTF-8 bytes from 0x80 up are parts of letters, so the word classes used here (given by ASCII bounds)
can be read off the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SYMBOLS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: no space of [\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: digits, lower-case letters, everything beyond ASCII
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a string or binary column; null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows [i, j) of at most ``most`` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base modulo 2**64, and their inverses."""
    size = max(CHUNK_BYTES + 1, 1 << int(n - 1).bit_length()) if n > CHUNK_BYTES + 1 else CHUNK_BYTES + 1
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i], times the inverse power i, the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words in ``data``; ``bounds``: n + 1 row offsets from 0, which end words."""
    m = inside[data]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(m))]
    start[cuts] = m[cuts]
    end[cuts - 1] = m[cuts - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(bounds, s, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; equal words have equal hashes in every process."""
    h = prefix_hash(data)
    return mix((h[ends] - h[starts]) * powers(len(data) + 1)[1][starts])


def hash_words(words: list[bytes]) -> np.ndarray:
    """`word_hashes` of words given one by one."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return word_hashes(data, np.r_[0, ends[:-1]].astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the runs of equal row numbers in the sorted ``rows``."""
    return np.searchsorted(rows, np.arange(n + 1))
