"""Word hashes of whole texts, computed on the UTF-8 bytes with numpy.

A word is a maximal run of ASCII digits, ASCII letters (A-Z count as a-z) and characters above U+007F;
on the bytes of UTF-8 that is a run of 0-9, a-z, A-Z and 0x80-0xFF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True
_CODE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE, _U = 0x9E3779B97F4A7C15, np.uint64
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2^64 and of its inverse, n of each at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each span; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and each text's place among them."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bound = offsets[1:-1]
    bound = bound[bound < len(data)]
    first[bound] = inside[bound]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = bound[bound > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(_CODE[data], start, end), np.searchsorted(start, offsets)


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out *= _U(_BASE)
        out += words[k : k + n]
    return mix(out)
