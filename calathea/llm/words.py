"""Vectorised words and 64-bit word hashes for Arrow batches of texts.

A word is a maximal run of bytes other than space and \\x09-\\x0D. A batch is cut into groups of whole
documents of about GROUP_BYTES, so memory follows the longest document and not the batch.
Null texts count as empty. Hashes are keyed polynomials over table-mapped bytes modulo 2**64 with a final
mix; they stand for words where equality is all that matters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

GROUP_BYTES = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U))
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, GROUP_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


@dataclass
class Words:
    """Words of consecutive documents: word w is data[starts[w]:ends[w]]; document d has words first[d]:first[d + 1]."""

    row: int
    data: np.ndarray
    doc_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def text(self, d: int) -> bytes:
        return self.data[self.doc_at[d] : self.doc_at[d + 1]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the rows' offsets in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Give memory that the allocators keep back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def groups(column: pa.Array, lower: bool = False, hashes: bool = True, limit: int = GROUP_BYTES) -> Iterator[Words]:
    """The column's documents in groups of whole documents."""
    data, at = column_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield _split(row, data[at[row] : at[last]], at[row : last + 1] - at[row], lower, hashes)
        row = last
    trim()


def _split(row: int, data: np.ndarray, at: np.ndarray, lower: bool, hashes: bool) -> Words:
    n = len(data)
    solid = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[at] = True
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    first = np.searchsorted(starts, at)
    h = np.zeros(0, _U)
    if hashes and len(starts):
        up, down = _power_tables(n + 1)
        sums = (_LOWER_TABLE if lower else _TABLE)[data]
        sums *= up[:n]
        np.cumsum(sums, out=sums)
        h = sums[ends - 1]
        h[starts > 0] -= sums[starts[starts > 0] - 1]
        h *= down[starts]
        h = mix(h + (ends - starts).astype(_U))
    return Words(row, data, at, starts, ends, first, h)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of `size` words that lies in one document, index of its first word)."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = w.hashes[:n].copy()
    for k in range(1, size):
        total = total * _U(_BASE) + w.hashes[k : k + n]
    doc = w.doc_of_word()
    keep = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[keep]), keep


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive entries, by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, done, block, width = None, 0, hashes.copy(), 1
    left = size
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * _U(pow(_BASE, width, 1 << 64)) + part
            done += width
        left >>= 1
        if left:
            block = block[:-width] * _U(pow(_BASE, width, 1 << 64)) + block[width:]
            width *= 2
    return mix(out)
