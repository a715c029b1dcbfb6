"""Sets of hashed word shingles, whole Arrow batches at a time (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from reviewops.llm.common import mix64, utf8_column

#: Bytes of text that are hashed at once.
CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_P = 0x5851F42D4C957F2D
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, at least n of each."""
    size = max(CHUNK, 1 << (n - 1).bit_length()) if n > 1 else CHUNK
    if size not in _POW:
        _POW.clear()
        _POW[size] = (_powers(_P, size), _powers(pow(_P, -1, 1 << 64), size))
    return _POW[size]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, byte offset of each word's start); words are lower-cased A-Z."""
    sep = _SEP[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _pow(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[:len(data)], dtype=np.uint64)))
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP), starts


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes, one row at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def shingle_sets(column, k: int = 4) -> Iterator[np.ndarray]:
    """For each text of an Arrow string array its sorted distinct shingle hashes (uint64).

    A text of fewer than k words has its whole sequence as one shingle; one
    without words has none.  A separator is put between rows, so no word or
    shingle spans two texts.
    """
    data, offsets = utf8_column(column)
    for lo, hi in pieces(offsets):
        part = data[offsets[lo]:offsets[hi]]
        bounds = offsets[lo:hi + 1] - offsets[lo]
        spaced = np.full(len(part) + hi - lo, 32, np.uint8)
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        spaced[np.arange(len(part)) + row] = part
        hashes, starts = word_hashes(spaced)
        first = np.searchsorted(starts, bounds + np.arange(hi - lo + 1))
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            rolled = (rolled + hashes[i:i + len(rolled)]) * _STEP
        rolled = mix64(rolled)
        for r in range(hi - lo):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                s = np.sort(rolled[a:b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for x in hashes[a:b]:
                    h = (h + x) * _STEP
                yield mix64(h + np.uint64(1))
            else:
                yield np.zeros(0, np.uint64)
