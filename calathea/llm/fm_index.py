"""Compressed FM-index of a shard of word sequences, and the matching statistics of streams of words against it.

The shard's sequences are joined with separators and their suffixes sorted by the first `size` symbols, which is all
that matches of up to `size` symbols need. The Burrows-Wheeler text is a wavelet tree in the shape of a prefix code:
a word of frequency f among n takes about log2(n / f) bits, and as many steps of a rank. One byte a suffix holds how
many symbols it has in common with the one before, which gives the parents of intervals.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Lengths of shared beginnings up to which a row's parent is looked up, as matches that fail are mostly short.
DIRECT = 6
SUPER = 9  # log2 of words in a superblock: its ones fit two bytes


class BitVector:
    """Bits with ranks: two bytes of counts for eight of bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        total = np.cumsum(ones) - ones
        self.super = total[:: 1 << SUPER].copy()
        self.before = (total - self.super[np.arange(len(ones)) >> SUPER]).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, rest = at >> 6, (at & 63).astype(_U)
        inside = np.bitwise_count(self.words[block] & ((_U(1) << rest) - _U(1)))
        return self.super[block >> SUPER] + self.before[block] + inside

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.super.nbytes + self.before.nbytes


class WaveletTree:
    """Occurrences of symbols in a sequence. All nodes' bits are one vector, level by level; a symbol leaves the tree
    where its code ends."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        count = np.maximum(1, np.bincount(symbols, minlength=alphabet))
        self.length = np.maximum(1, np.ceil(np.log2(count.sum() / count))).astype(np.uint8)
        self.depth = int(self.length.max())
        order = np.argsort(self.length, kind="stable")
        share = np.int64(1) << (self.depth - self.length[order].astype(np.int64))
        self.code = np.empty(alphabet, np.int64)  # codes fill up to the depth with zeros, shorter ones first
        self.code[order] = np.cumsum(share) - share
        code, length = self.code[symbols], self.length[symbols]
        bits, self.children, starts, base = [], [], [], 0
        node = np.zeros(len(symbols), np.int64)
        for level in range(self.depth):
            bit = code >> (self.depth - 1 - level) & 1
            bits.append(bit.astype(bool))
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(1, np.int64)
            starts.append(base + first)
            base += len(bit)
            # stably by bit within each node
            zeros = np.cumsum(1 - bit) - (1 - bit)
            sizes = np.diff(np.append(first, len(bit)))
            within = np.diff(np.append(zeros[first], len(bit) - bit.sum())) if len(node) else np.zeros(1, np.int64)
            begin = np.repeat(first, sizes)
            left = begin + zeros - np.repeat(zeros[first], sizes) if len(node) else begin
            right = np.repeat(first + within, sizes) + np.arange(len(bit)) - left
            to = np.empty(len(bit), np.int64)
            to[np.where(bit == 0, left, right)] = np.arange(len(bit))
            to = to[length[to] > level + 1]
            key = 2 * node[to] + bit[to]
            code, length = code[to], length[to]
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            child = np.full(2 * len(first), -1, np.int32)
            child[key[new]] = np.arange(int(new.sum()))
            self.children.append(child)
            node = np.cumsum(new) - 1
        self.bits = BitVector(np.concatenate(bits))
        self.starts = [x.astype(np.int32 if base < 1 << 31 else np.int64) for x in starts]
        self.ones = [self.bits.rank(x).astype(x.dtype) for x in self.starts]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each of its places; `at` has a row for each place of a symbol."""
        length = self.length[symbol]
        order = np.argsort(self.depth - length, kind="stable")  # long codes first: those that go on are a slice
        code, out = self.code[symbol[order]], np.ascontiguousarray(at[:, order], np.int64)
        going = len(symbol) - np.concatenate([[0], np.cumsum(np.bincount(length, minlength=self.depth + 1))])
        node = np.zeros(len(symbol), np.int32)
        for level in range(self.depth):
            k = going[level + 1]
            if not k:
                break
            bit = (code[:k] >> (self.depth - 1 - level) & 1).astype(bool)
            n = node[:k]
            ones = self.bits.rank(out[:, :k] + self.starts[level][n]) - self.ones[level][n]
            out[:, :k] = np.where(bit, ones, out[:, :k] - ones)
            node[:k] = self.children[level][2 * n + bit]
        result = np.empty_like(out)
        result[:, order] = out
        return result

    @property
    def nbytes(self) -> int:
        return self.bits.nbytes + sum(x.nbytes for part in (self.starts, self.ones, self.children) for x in part)


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by (first, second), dense rank of each entry)."""
    key = first.astype(_U) << _U(32) | second.astype(_U)
    order = np.argsort(key, kind="stable")
    step = np.zeros(len(key), np.int64)
    step[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


def _shift(rank: np.ndarray, by: int) -> np.ndarray:
    """The entry `by` places on, plus one; 0 past the end."""
    out = np.zeros(len(rank), np.int64)
    out[: len(rank) - by] = rank[by:] + 1
    return out


def _common(text: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """How many symbols each sorted suffix has in common with the one before, `size` at most."""
    out, same = np.zeros(len(order), np.uint8), np.arange(1, len(order))
    for k in range(size):
        a, b = order[same] + k, order[same - 1] + k
        same = same[(a < len(text)) & (b < len(text))]
        same = same[text[order[same] + k] == text[order[same - 1] + k]]
        if not len(same):
            break
        out[same] = k + 1
    return out


class FMIndex:
    """Index of sequences (flat words and lengths) with a weight each, for matches of up to `size` words."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray, size: int):
        if size > 255:
            raise ValueError("matches of more than 255 words")
        self.size = size
        self.alphabet = np.unique(flat)
        total = len(flat) + len(lengths)
        starts = np.cumsum(lengths + 1) - lengths - 1
        separator = np.zeros(total, bool)
        separator[starts + lengths] = True
        text = np.zeros(total, np.int64)
        text[~separator] = np.searchsorted(self.alphabet, flat) + 1
        weight = np.repeat(weights, lengths + 1)
        rank, width, order = text, 1, np.argsort(text, kind="stable")
        while width < size:
            step = min(width, size - width)
            order, rank = _ranks(rank, _shift(rank, step))
            width += step
        self.common = _common(text, order, size)
        self.starts_of = np.searchsorted(text[order], np.arange(len(self.alphabet) + 1))
        self.bwt = WaveletTree(text[order - 1], len(self.alphabet) + 1)
        self.weight_before = np.concatenate([[0], np.cumsum(weight[order])])
        self.total = total
        # rows that share all but the last symbol, which whole matches are cut to: found directly
        new = self.common < max(1, size - 1) if size > 1 else np.arange(total) == 0
        self._kind = kind = np.int32 if total < 1 << 31 else np.int64
        self._almost, self._starts = (np.cumsum(new) - 1).astype(kind), np.append(np.flatnonzero(new), total).astype(kind)
        self._heads: dict[int, tuple] = {}

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of `symbol` followed by what the rows low:high begin with."""
        low, high = self.bwt.rank(symbol, np.stack([low, high])) + self.starts_of[symbol]
        return low, high

    def parent(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share their first `length` symbols with a row."""
        start, stop = np.zeros(len(low), np.int64), np.full(len(low), self.total)
        order = np.argsort(length.astype(np.uint8), kind="stable")
        edges = np.searchsorted(length[order], np.arange(self.size + 1))
        for n in np.flatnonzero(np.diff(edges)).tolist():
            if n:
                if n not in self._heads:
                    new = self.common < n
                    number = (np.cumsum(new) - 1).astype(self._kind) if n <= DIRECT else None
                    self._heads[n] = np.append(np.flatnonzero(new), self.total).astype(self._kind), number
                heads, number = self._heads[n]
                at = order[edges[n] : edges[n + 1]]
                k = number[low[at]] if number is not None else np.searchsorted(heads, low[at].astype(self._kind), "right") - 1
                start[at], stop[at] = heads[k], heads[k + 1]
        return start, stop

    def matching_statistics(self, flat: np.ndarray, lengths: np.ndarray, least: int = 1, piece: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the streamed sequences: the length of the longest match from it, `size` at most, that occurs
        at indexed places of a summed weight of `least` or more, and that weight.

        From right to left, one backward step a word; where a step fails, the match is cut at its right end to the
        longest that goes on. Sequences are cut into pieces that overlap by size - 1, all worked off side by side.
        """
        size, out, weights = self.size, np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, flat), max(0, len(self.alphabet) - 1))
        known = self.alphabet[at] == flat if len(self.alphabet) else np.zeros(len(flat), bool)
        symbols = np.where(known, at + 1, 0)
        ends = np.cumsum(lengths)
        pieces = -(-lengths // piece)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = (ends - lengths)[owner] + nth * piece
        stop = np.minimum(first + piece + size - 1, ends[owner])
        own = np.minimum(first + piece, ends[owner])  # words from here on are the next piece's
        order = np.argsort(first - stop, kind="stable")
        first, stop, own = first[order], stop[order], own[order]
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.total)
        have = np.zeros(len(first), np.int64)
        for step in range(int((stop - first).max()) if len(first) else 0):
            live = int(np.searchsorted(first - stop, -step, "left"))
            lo, hi, n = low[:live], high[:live], have[:live]
            where = stop[:live] - 1 - step
            full = np.flatnonzero(n == size)
            k = self._almost[lo[full]]
            lo[full], hi[full] = self._starts[k], self._starts[k + 1]
            n[full] -= 1
            s = symbols[where]
            a, b = self.extend(s, lo, hi)
            fine = (s > 0) & (self._weight(a, b) >= least)
            bad = np.flatnonzero(~fine)
            if len(bad):
                a[bad], b[bad], n[bad] = self._cut(s[bad], lo[bad], n[bad], least)
            n[fine] += 1
            lo[:], hi[:] = a, b
            done = np.flatnonzero(where < own[:live])
            out[where[done]] = n[done]
            weights[where[done]] = np.where(n[done] > 0, self._weight(lo[done], hi[done]), 0)
        return out, weights

    def _weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.where(low < high, self.weight_before[high] - self.weight_before[low], 0)

    def _cut(self, symbol: np.ndarray, low: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After failed steps: (rows, length) of the longest matches of the symbol and what is left of the match behind
        it. The shorter what is left, the more rows it has, so its length is found by halving."""
        a, b, length = np.zeros(len(symbol), np.int64), np.full(len(symbol), self.total), np.zeros(len(symbol), np.int64)
        fewest, most = np.zeros(len(symbol), np.int64), n.copy()  # lengths left that may go on: from fewest, below most
        open_ = np.flatnonzero((symbol > 0) & (most > 0))
        # a symbol that doesn't go on alone, with nothing left behind it, has no match
        while len(open_):
            middle = (fewest[open_] + most[open_]) >> 1
            x, y = self.extend(symbol[open_], *self.parent(low[open_], middle))
            fine = self._weight(x, y) >= least
            good = open_[fine]
            a[good], b[good], length[good] = x[fine], y[fine], middle[fine] + 1
            fewest[good] = middle[fine] + 1
            most[open_[~fine]] = middle[~fine]
            open_ = open_[fewest[open_] < most[open_]]
        return a, b, length
