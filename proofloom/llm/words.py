"""Words and word windows of Arrow text columns as numpy arrays, whole batches at a time.

A word is ``[^\\x20\\x09-\\x0D]+``; those separators are single bytes in UTF-8, so everything here works on the bytes.
Hashes are 64 bits: a polynomial over a word's bytes, mixed, and a polynomial over the hashes of a window's words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BYTE = np.arange(1, 257, dtype=U64)
_LOWER = _BYTE.copy()
_LOWER[65:91] += U64(32)
#: Multipliers of the two polynomials (odd, so that the first has an inverse modulo 2^64).
_P, _Q = 0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93
#: Bytes that are hashed at a time; the powers beyond follow from those of the first ones.
_CHUNK = 1 << 16


def _first_powers(p: int) -> np.ndarray:
    t = np.full(_CHUNK, p, U64)
    t[0] = 1
    return np.multiply.accumulate(t)


_INVERSE = pow(_P, -1, 1 << 64)
_UP, _DOWN = _first_powers(_P), _first_powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pieces(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most most_bytes of text, or one longer row. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words begin and end, and the number of words of each row."""
    inside = ~_GAP[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first[off[:-1][full]] = inside[off[:-1][full]]
    last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.diff(np.searchsorted(s, off))


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash for each word; lower: as if A-Z were a-z. Bytes are read in chunks, so memory grows with the words alone."""
    letters = _LOWER if lower else _BYTE
    step, back = pow(_P, _CHUNK, 1 << 64), pow(_INVERSE, _CHUNK, 1 << 64)
    out = np.zeros(len(s), U64)
    down = np.empty(len(s), U64)
    sums = np.zeros(_CHUNK + 1, U64)
    carry, scale, unscale = 0, 1, 1
    i = j = 0
    for lo in range(0, len(data), _CHUNK):
        x = letters[data[lo : lo + _CHUNK]]
        x *= _UP[: len(x)]
        x *= U64(scale)
        x[:1] += U64(carry)
        np.cumsum(x, out=sums[1 : len(x) + 1])
        sums[0] = carry
        i2, j2 = np.searchsorted(s, lo + len(x)), np.searchsorted(e, lo + len(x), side="right")
        at = s[i:i2] - lo
        out[i:i2] -= sums[at]
        down[i:i2] = _DOWN[at] * U64(unscale)
        out[j:j2] += sums[e[j:j2] - lo]
        i, j, carry = i2, j2, int(sums[len(x)])
        scale, unscale = scale * step % (1 << 64), unscale * back % (1 << 64)
    out *= down
    return mix(out)


def windows(h: np.ndarray, counts: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay within a row, and the index of each one's first word. Seeds give independent hashes."""
    q = pow(_Q, 2 * seed + 1, 1 << 64)
    if len(h) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    g = h[:n].copy()
    for i in range(1, k):
        g *= U64(q)
        g += h[i : i + n]
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(g[at] + U64(seed)), at


def tidied(f: Callable[..., Iterator[pa.RecordBatch]], **given) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for ``mapInArrow``, given its further arguments. After the last batch, what its arrays took goes back to the system: workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches, **given)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def row_slices(counts: np.ndarray) -> np.ndarray:
    """Offsets of each row's words."""
    return np.concatenate(([0], np.cumsum(counts)))
