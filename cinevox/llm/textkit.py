"""Vectorised text kernels that run inside Spark tasks.

Everything here works on one Arrow batch at a time: the UTF-8 buffer of a string
column and its row offsets.  A word is a maximal run of bytes outside
``0x20 0x09-0x0D``; all separators are ASCII, so words can be cut on the UTF-8
bytes.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
"""Bytes handled at once, so that the 8-byte work arrays stay in cache; a longer row is a block of its own."""

_U = np.uint64
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 747_796_405)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, at least ``n`` of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for step in (base, pow(base, -1, _PRIME)):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                table[done : done + more] = table[:more] * _U(pow(step, done, _PRIME)) % _U(_PRIME)
                done += more
            tables.append(table)
        _POWERS[base] = tables[0], tables[1]
    return _POWERS[base]


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder by the prime; below 2^32 for any below 2^62."""
    high = x >> _U(31)
    x &= _U(_PRIME)
    x += high
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


def utf8(column: pa.Array, kind: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or, by ``kind``, binary) column and its ``len + 1`` row offsets."""
    column = pc.fill_null(column.cast(kind), "" if pa.types.is_large_string(kind) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together have at most ``size`` bytes, or one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, rows)
        row = end


class RangeHash:
    """Hashes of arbitrary byte ranges of one buffer, from prefix sums.

    A range is a polynomial with its bytes as coefficients, at two points modulo
    the prime 2^31 - 1.  Modulo a prime, unlike a power of two, no family of texts
    agrees at every point: two ranges of ``n`` bytes agree at no more than ``n``.
    """

    def __init__(self, data: np.ndarray):
        self._sums, self._inverses = [], []
        digits = data.astype(np.uint64)
        digits += _U(1)
        for base in _BASES:
            power, inverse = _powers(base, len(data) + 1)
            terms = digits * power[: len(data)]
            if len(data) > 1 << 22:
                terms = _fold(terms)  # or the sums would not stay below 2^62
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self._sums.append(sums)
            self._inverses.append(inverse)

    @staticmethod
    def _value(parts: list[np.ndarray]) -> np.ndarray:
        left, right = (_fold(_fold(x)) for x in parts)
        for x in (left, right):
            x[x >= _U(_PRIME)] -= _U(_PRIME)
        left <<= _U(31)
        left |= right
        return mix(left)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._value([_fold(s[end] - s[start]) * inverse[start] for s, inverse in zip(self._sums, self._inverses, strict=True)])

    def grams(self, k: int) -> np.ndarray:
        """Of the ``k`` bytes from each position."""
        n = max(0, len(self._sums[0]) - k)
        return self._value([_fold(s[k:] - s[:n]) * inverse[:n] for s, inverse in zip(self._sums, self._inverses, strict=True)])


def joined(value: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a sequence that goes on with another item."""
    return (value ^ (value >> _U(29))) * _U(0xD1342543DE82EF95) + following


@dataclass
class Words:
    """Words of a block of rows: byte ranges in the block, hashes, and each row's range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on that has as many in its row, and these words' indexes."""
        row = self.row()
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        value = np.zeros(len(at), np.uint64)
        for i in range(n):
            value = joined(value, self.hash[at + i])
        return mix(value), at


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows whose bytes are ``data[offsets[i]:offsets[i + 1]]``; ``lower`` maps A-Z to a-z."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SEPARATOR[data], out=inside[1:-1])
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(start, end, RangeHash(data).of(start, end), np.searchsorted(start, offsets))
