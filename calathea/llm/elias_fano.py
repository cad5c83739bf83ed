"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each, with vectorised searches.

High parts are unary in a bit vector, low parts packed in 64-bit words. A running count of zeros per 64 bits of the
high part leads to the run of equal high parts; within it low parts are searched by halving.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SELECT = np.full((256, 8), 8, np.uint8)  # place of the k-th one of a byte
for _x in range(256):
    for _k, _p in enumerate(p for p in range(8) if _x >> p & 1):
        _SELECT[_x, _k] = _p


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sequence of non-decreasing integers below `universe`."""
    n = len(values)
    low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    v = values.astype(_U)
    high = (v >> _U(low_bits)).astype(np.int64)
    bits = np.zeros(((n + (universe >> low_bits) + 1) // 64 + 1) * 64, bool)
    bits[high + np.arange(n)] = True
    words = np.packbits(bits, bitorder="little").view(_U)
    zeros = np.zeros(len(words) + 1, np.uint32)
    np.cumsum(64 - np.bitwise_count(words).astype(np.int64), out=zeros[1:])
    low = np.zeros(n * low_bits // 64 + 2, _U)
    if low_bits and n:
        rest = v & ((_U(1) << _U(low_bits)) - _U(1))
        at = np.arange(n, dtype=np.int64) * low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(low, word, rest << shift)
        over = np.flatnonzero(shift.astype(np.int64) + low_bits > 64)
        np.bitwise_or.at(low, word[over] + 1, rest[over] >> (_U(64) - shift[over]))
    return {"head": np.array([n, low_bits], np.int64), "high": words, "zeros": zeros, "low": low}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["head"])
        self.high, self.zeros, self.low = arrays["high"], arrays["zeros"], arrays["low"]
        self.mask = _U((1 << self.bits) - 1)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), _U)
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(_U)
        out = self.low[word] >> shift
        over = np.flatnonzero(shift.astype(np.int64) + self.bits > 64)
        out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & self.mask

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high part, counted from 0; -1 for k = -1."""
        some = np.maximum(k, 0)
        word = np.searchsorted(self.zeros, some.astype(np.uint32), "right") - 1
        rest = (some - self.zeros[word]).astype(_U)
        raw, at = ~self.high[word], word << 6
        for width in (32, 16, 8):
            low = np.bitwise_count(raw & _U((1 << width) - 1)).astype(_U)
            above = rest >= low
            rest -= low * above
            raw >>= above * _U(width)
            at += above * width
        return np.where(k < 0, -1, at + _SELECT[raw & _U(255), rest])

    def _ones(self, at: np.ndarray) -> np.ndarray:
        """Length of the run of ones from each place; -1 if it leaves the word."""
        shift = (at & 63).astype(_U)
        gap = ~(self.high[at >> 6] >> shift)
        run = np.bitwise_count((gap & (~gap + _U(1))) - _U(1)).astype(np.int64)
        return np.where(run + shift.astype(np.int64) >= 64, -1, run)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Successor search: the place of each integer in the sequence, -1 where its successor is another."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(_U)
        high, rest = (x >> _U(self.bits)).astype(np.int64), x & self.mask
        last = int(self.zeros[-1]) - 1
        inside = high <= last
        high = np.minimum(high, last)
        first = self._zero(high - 1) + 1
        start = first - high
        run = self._ones(first)
        far = np.flatnonzero(run < 0)
        if len(far):
            run[far] = self._zero(high[far]) - first[far]
        stop = np.minimum(start + run, self.n)
        lo, hi = start, stop.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < rest[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        ok = inside & (lo < stop)
        ok[ok] = self._low(lo[ok]) == rest[ok]
        return np.where(ok, lo, -1)

    def values(self) -> np.ndarray:
        """All integers of the sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(_U) << _U(self.bits)) | self._low(np.arange(self.n))
