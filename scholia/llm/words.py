"""Vectorised word and n-gram hashing over the buffers of an Arrow text column.

Words are maximal runs of bytes outside a separator set; no Python string is
made for them. A word's hash is a difference of prefix sums of a polynomial over
64-bit byte codes, then mixed; n-gram hashes are mixed sums of word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: `[^\x20\x09-\x0D]+`
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 21)
        with np.errstate(over="ignore"):
            steps = np.full(n + 1, _BASE, np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps)
            steps[1:] = _BASE_INVERSE
            _inverses = np.cumprod(steps)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's offset in them (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column, "") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Word spans of all rows: start and end byte, row, and the rows' first words (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> None:
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z."""
        return span_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _powers[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _factor(i: int, salt: int) -> np.uint64:
    return mix(np.array([(i + 1) * 0xA0761D6478BD642F + salt * 0xE7037ED1A0B428DB & (1 << 64) - 1], np.uint64))[0] | _U(1)


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each position on, for the len - n + 1 positions that have n.

    Rows aren't told apart here: the caller drops those that leave a row.
    """
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total += hashes[i : i + count] * _factor(i, salt)
    return mix(total)
