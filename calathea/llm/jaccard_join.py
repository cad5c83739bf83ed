"""N-gram Jaccard join: which documents' shingle sets overlap enough, and the components that the links make.

Method. Documents with equal sets form one class, and one row of the incidence matrix (set by n-gram); every set enters
with all its columns, whatever its size. Which sets link follows from the product of the matrix with its transpose,
worked off in blocks of columns that accumulate overlap counts. What a set's size rules out is left out of it:

* A set of n links only to sets with which it has t = ceil(0.75 n) columns in common. So of any two linked sets, the
  first n - t + k columns by hash have k in common, k about n / 8: sets with fewer shared columns there go first.
* Of the rest, sets with m < t columns that another has go; the others are the rows of the product.
* First product: of each column, the set that leads it with all its others of matching size. Counts are summed over the
  blocks; a pair whose count reaches the threshold is linked (a count from columns with another leader is missing, so
  it may be short, never long). A group of copies costs its postings, not its pairs.
* Second product: pairs that the first left in different components, over each set's m - t + 1 rarest columns, one of
  which any linked pair has in common. Each set brings a bit map of its columns, of twice as many bits or more: bits
  that only one of two sets has are columns that the other lacks, so they bound the overlap, and pairs under the
  threshold aren't counted. Pairs whose count, with all other columns added, is under the threshold go as well; those
  left are multiplied out over all their columns, block by block. Pairs inside a component aren't counted, as nothing
  depends on them.

Columns of very many sets (HOT_SHARE of all or more, found in batches and summed) are known to be shared: they pass
around the blocks, and come last in the order. Long lists are cut into chunks, and each two chunks are a task's work.

Defined results: a null or wordless text has n_shingles 0 and is a component of itself; a text with fewer words
than a shingle is one shingle; equal rows are in one class; a null id keeps its row, with a null component unless
its class has another id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import words as wd
from .graph import components
from .shared import column, cut

FILTER_PART = 8
BLOCK_POSTINGS = 500_000
BLOCK_EDGES = 2_000
HOT_LEAST, HOT_SHARE = 32, 1_000
HOT_CHUNK = 100_000
CHUNK = 2_048
PAIRS_HELD = 4_000_000
POSTINGS_HELD = 1_500_000
BLOBS = "block long, blob binary"
_U = np.uint64


def shingle_sets(g: wd.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of the distinct shingles of a group, by document."""
    h, at = wd.rolling(g.hashes, size), np.zeros(0, np.int64)
    doc = g.doc_of_word()
    if len(h):
        at = np.flatnonzero(doc[: len(h)] == doc[size - 1 :])
        h = h[at]
    d = doc[at]
    lengths = np.diff(g.first)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        whole = np.array([wd.rolling(g.hashes[g.first[k] : g.first[k + 1]], int(lengths[k]))[0] for k in short], _U)
        h, d = np.concatenate([h, wd.mix(whole + lengths[short].astype(_U))]), np.concatenate([d, short])
    order = np.argsort(h)
    d, h = d[order], h[order]
    order = np.argsort(d.astype(np.uint16) if g.docs < 65536 else d, kind="stable")
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _signature(d: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two 64-bit signatures) by document."""
    n = np.bincount(d, minlength=docs)
    s1, s2 = np.zeros(docs, _U), np.zeros(docs, _U)
    full = np.flatnonzero(n)
    if len(full):
        first = np.searchsorted(d, full)
        s1[full] = wd.mix(np.add.reduceat(h, first) + n[full].astype(_U))
        s2[full] = wd.mix(np.add.reduceat(wd.mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), first))
    return n, s1.view(np.int64), s2.view(np.int64)


def common_least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Size-derived bound: columns that a set of size n has in common with any that it links to."""
    return -(-num * n // den)


def prefix_least(n: np.ndarray) -> np.ndarray:
    """How many common columns the filter asks of the first ones of a set of size n; grows with n, never above the bound."""
    return np.maximum(1, n // FILTER_PART)


PROFILE = "doc_id long, n long, s1 long, s2 long"


def _distinct(sigs: np.ndarray, seen: set) -> np.ndarray:
    return np.array([s not in seen and not seen.add(s) for s in sigs.tolist()], bool)


def _frequent(columns: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns that occur at least so often, how often)."""
    cell = (columns >> _U(44)).astype(np.int64)
    full = np.bincount(cell, minlength=1 << 20) >= least
    found, count = np.unique(columns[full[cell]], return_counts=True)
    return found[count >= least], count[count >= least]


def _profile(size: int) -> Callable:
    """Size and signatures of each document's set; rows with n below 0 are columns (s1) that -n sets of a stretch of
    documents have."""

    def frequent(cols: list[np.ndarray]) -> pa.RecordBatch:
        hot, count = _frequent(np.concatenate(cols), HOT_LEAST)
        zero = np.zeros(len(hot), np.int64)
        return pa.record_batch([pa.nulls(len(hot), pa.int64()), pa.array(-count), pa.array(hot.view(np.int64)), pa.array(zero)], names=["doc_id", "n", "s1", "s2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, cols, held, seen = [], [], 0, set()
            for g in wd.groups(batch.column(1), lower=True):
                d, h = shingle_sets(g, size)
                parts.append(_signature(d, h, g.docs))
                cols.append(wd.mix(h[_distinct(parts[-1][1], seen)[d]]))
                held += len(cols[-1])
                if held > POSTINGS_HELD:
                    yield frequent(cols)
                    cols, held = [], 0
            if parts:
                n, s1, s2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.record_batch([batch.column(0), pa.array(n), pa.array(s1), pa.array(s2)], names=["doc_id", "n", "s1", "s2"])
            if cols:
                yield frequent(cols)

    return run


def _deal(key: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, entries dealt to it) by the upper half of 64-bit keys."""
    block = ((key >> _U(32)) * _U(blocks)) >> _U(32)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1).astype(_U))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


_BLOCK = pa.schema([("block", pa.int64()), ("blob", pa.binary())])


def _blocks(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=_BLOCK)


def _postings(size: int, blocks: int, hot: np.ndarray, num: int, den: int, filled: np.ndarray | None = None) -> Callable:
    """Columns of each distinct set of a batch, dealt into blocks of columns; hot ones past them, into blocks of sets,
    which have numbers below 0. Without a filter of ids, the first columns of each set; with one, all columns of those."""

    def dealt(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        tok, doc, sig, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        common = _among(tok, hot) >= 0
        out, rare = [], np.flatnonzero(~common)
        for k, at in _deal(tok[rare], blocks):
            own, ref = np.unique(doc[rare[at]], return_inverse=True)
            out.append((k, _pack(tok[rare[at]], ref, sig[own], n[own])))
        if common.any():
            tok, doc = tok[common], doc[common]
            out += [(-1 - k, x) for k, x in _by_sets(tok, sig[doc], n[doc], (1 << 31) + _among(tok, hot), blocks)]
        yield from _blocks(out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, base, held, seen = [], 0, 0, set()
            texts = batch.column(1) if filled is None else batch.column(1).filter(pa.array(bloom.test(filled, batch.column(0))))
            for g in wd.groups(texts, lower=True):
                d, h = shingle_sets(g, size)
                n, s1, _ = _signature(d, h, g.docs)
                keep, tok = _distinct(s1, seen)[d], wd.mix(h)
                if filled is None:
                    order = np.lexsort((tok, d))
                    d, tok, keep = d[order], tok[order], keep[order]
                    place = np.arange(len(d)) - np.searchsorted(d, np.arange(g.docs))[d]
                    keep &= place < (n - common_least(n, num, den) + prefix_least(n))[d]
                parts.append((tok[keep], d[keep] + base, s1, n))
                base, held = base + g.docs, held + len(parts[-1][0])
                if held > POSTINGS_HELD:
                    yield from dealt(parts)
                    parts, base, held = [], 0, 0
            if parts:
                yield from dealt(parts)

    return run


def _among(columns: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Places of columns in the sorted table of hot ones; -1: not there."""
    if not len(hot):
        return np.full(len(columns), -1, np.int64)
    at = np.minimum(np.searchsorted(hot, columns), len(hot) - 1)
    return np.where(hot[at] == columns, at, -1)


def _by_sets(tok: np.ndarray, sig: np.ndarray, n: np.ndarray, count: np.ndarray, blocks: int) -> list[tuple[int, bytes]]:
    """Shared columns with their counts, dealt into blocks of sets."""
    out = []
    for k, at in _deal(wd.mix(sig.view(_U)), blocks):
        own, first, ref = np.unique(sig[at], return_index=True, return_inverse=True)
        parts = np.array([len(at), len(own)], "<i8"), tok[at], count[at].astype("<u4"), ref.astype("<u4"), own, n[at][first]
        out.append((k, b"".join(x.tobytes() for x in parts)))
    return out


def _shared(blocks: int) -> Callable:
    """Of a block of columns: those of two sets or more, dealt back by set, with each column's count."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        if block < 0:
            return _blocks([(-1 - block, x) for x in table.column("blob").to_pylist()])
        tok, sig, n = _columns(table)
        if not len(tok):
            return _BLOCK.empty_table()
        head = np.append(True, tok[1:] != tok[:-1])
        count = np.diff(np.append(np.flatnonzero(head), len(tok)))[np.cumsum(head) - 1]
        return _blocks(_by_sets(tok, sig, n, np.minimum(count, (1 << 31) - 1), blocks))

    return run


def _by_set(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, set, its size, first row of each set, rows of each set), rarest columns first within a set."""
    parts = [[], [], [], []]
    for blob in table.column("blob").to_pylist():
        (t, s), at, read = np.frombuffer(blob, "<i8", 2), 16, []
        for kind, k in (("<u8", t), ("<u4", t), ("<u4", t), ("<i8", s), ("<i8", s)):
            read.append(np.frombuffer(blob, kind, k, at))
            at += read[-1].nbytes
        tok, count, ref, own, n = read
        for out, x in zip(parts, (tok, count, own[ref], n[ref]), strict=True):
            out.append(x)
    tok, count, sig, n = (np.concatenate(x) for x in parts)
    order = np.lexsort((tok, count, sig))
    tok, sig, n = tok[order], sig[order], n[order]
    new = np.append(True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])) if len(tok) else np.zeros(0, bool)
    tok, sig, n = tok[new], sig[new], n[new]
    starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    return tok, sig, n, starts, np.diff(np.append(starts, len(sig)))


def _able(num: int, den: int) -> Callable:
    """Of a block of sets: those that have enough shared columns among their first."""

    def run(table: pa.Table) -> pa.Table:
        _, sig, n, starts, m = _by_set(table)
        return pa.table({"s1": pa.array(sig[starts][m >= prefix_least(common_least(n[starts], num, den))])})

    return run


SETS = "sig long, n long, m long, columns binary, bits binary"


def _map_size(n: np.ndarray) -> np.ndarray:
    """log2 of the bits in the map of a set of size n: at least two for each column, 64 at least."""
    return np.maximum(6, np.ceil(np.log2(2.0 * np.maximum(1, n))).astype(np.int64))


def _bit_map(columns: np.ndarray, log2: int) -> np.ndarray:
    bits = np.zeros(1 << log2, bool)
    bits[(wd.mix(columns) & _U((1 << log2) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(_U)


class _Maps:
    """Bit maps of sets by number, at their own size and folded to the half of it; sizes of sets to compare differ by
    less than that."""

    def __init__(self, n: np.ndarray, raw: list[bytes]):
        self.log2 = _map_size(n)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.concatenate([self.log2, self.log2 - 1])).tolist():
            at = np.flatnonzero((self.log2 == k) | (self.log2 == k + 1))
            place = np.zeros(len(n), np.int64)
            place[at] = np.arange(len(at))
            half = [np.frombuffer(raw[i], _U) for i in at.tolist()]
            if k >= 6:
                self.rows[k] = place, np.stack([x if len(x) == 1 << (k - 6) else x[: len(x) // 2] | x[len(x) // 2 :] for x in half])

    def only(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many columns of set i, at least, set j lacks, and the other way round, for pairs of sets."""
        a, b = np.zeros((2, len(i)), np.int64)
        size = np.minimum(self.log2[i], self.log2[j])
        for k in np.unique(size).tolist():
            place, rows = self.rows[k]
            here = np.flatnonzero(size == k)
            for at in np.array_split(here, max(1, len(here) * rows.shape[1] >> 22)):
                x, y = rows[place[i[at]]], rows[place[j[at]]]
                a[at], b[at] = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        return a, b


def _rows_of_product(num: int, den: int) -> Callable:
    """Of a block of whole sets: those with as many shared columns (m) as the bound of their size, and these columns,
    rarest first."""

    def run(table: pa.Table) -> pa.Table:
        tok, sig, n, starts, m = _by_set(table)
        keep = np.flatnonzero(m >= common_least(n[starts], num, den))
        cols = [tok[starts[k] : starts[k] + m[k]].astype("<u8") for k in keep]
        bits = [_bit_map(x, k).tobytes() for x, k in zip(cols, _map_size(n[starts][keep]).tolist(), strict=True)]
        return pa.table({"sig": pa.array(sig[starts][keep]), "n": pa.array(n[starts][keep]), "m": pa.array(m[keep]), "columns": pa.array([x.tobytes() for x in cols], pa.binary()), "bits": pa.array(bits, pa.binary())})

    return run


def _repost(blocks: int, hot: np.ndarray, salts: np.ndarray) -> Callable:
    """The columns of sets dealt into blocks, a hot one's into several; a set's size field holds n and, above 32 bits, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, m = (batch.column(k).to_numpy() for k in range(3))
            cols = [np.frombuffer(x, "<u8") for x in batch.column(3).to_pylist()]
            if cols:
                tok, doc = np.concatenate(cols), np.repeat(np.arange(len(cols)), list(map(len, cols)))
                at = _among(tok, hot)
                salt = wd.mix(sig[doc].view(_U)) % np.where(at >= 0, salts[at] if len(salts) else 1, 1).astype(_U)
                out = []
                for k, at in _deal(wd.mix(tok ^ salt * _U(0x9E3779B97F4A7C15)), blocks):
                    own, ref = np.unique(doc[at], return_inverse=True)
                    out.append((k, _pack(tok[at], ref, sig[own], n[own] | m[own] << 32)))
                yield from _blocks(out).to_batches()

    return run


def _pack(tok: np.ndarray, ref: np.ndarray, sig: np.ndarray, n: np.ndarray) -> bytes:
    head = np.array([len(tok), len(sig)], np.int64).tobytes()
    low = tok & _U(0xFFFFFFFFFFFF)
    return b"".join([head, (low & _U(0xFFFFFFFF)).astype("<u4").tobytes(), (low >> _U(32)).astype("<u2").tobytes(), ref.astype("<u4" if len(sig) > 65535 else "<u2").tobytes(), sig.astype("<i8").tobytes(), n.astype("<i8").tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, s = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for kind, k in (("<u4", t), ("<u2", t), ("<u4" if s > 65535 else "<u2", t), ("<i8", s), ("<i8", s)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    low, high, ref, sig, n = out
    return low.astype(_U) | high.astype(_U) << _U(32), sig[ref], n[ref]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, set, its size field) of a block's columns that two sets or more have, by column, size and set."""
    parts = [_unpack(x) for x in table.column("blob").to_pylist()]
    tok, sig, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(tok, kind="stable")
    for _ in range(2):
        same = tok[order][1:] == tok[order][:-1]
        shared = np.zeros(len(tok), bool)
        shared[1:] |= same
        shared[:-1] |= same
        at = order[shared]
        tok, sig, n = tok[at], sig[at], n[at]
        order = np.lexsort((sig, n & 0xFFFFFFFF, tok))
        tok, sig, n = tok[order], sig[order], n[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        tok, sig, n = tok[new], sig[new], n[new]
        order = np.arange(len(tok))
    return tok, sig, n


COUNTS = "a long, b long, na long, nb long, common long"
_COUNTS = pa.schema([(c, pa.int64()) for c in ("a", "b", "na", "nb", "common")])


def _first_product(num: int, den: int) -> Callable:
    """Of a block of columns: how many of them each leader has in common with each set that it leads."""

    def run(table: pa.Table) -> pa.Table:
        tok, sig, n = _columns(table)
        if not len(tok):
            return _COUNTS.empty_table()
        n, m = n & 0xFFFFFFFF, n >> 32
        order = np.lexsort((sig, n, -m / n, tok))  # those with the fewest columns of their own lead
        tok, sig, n, m = tok[order], sig[order], n[order], m[order]
        head = np.append(True, tok[1:] != tok[:-1])
        run_of = np.cumsum(head) - 1
        lead = np.flatnonzero(head)[run_of]
        while True:  # those too large or small for their leader follow the first such one of their run
            far = np.flatnonzero(num * np.maximum(n, n[lead]) > den * np.minimum(n, n[lead]))
            if not len(far):
                break
            first = np.append(True, run_of[far[1:]] != run_of[far[:-1]])
            lead[far] = far[first][np.cumsum(first) - 1]
        least = np.minimum(m, m[lead])
        led = np.flatnonzero((lead != np.arange(len(tok))) & (den * least >= num * (n + n[lead] - least)))
        own, number = np.unique(sig, return_inverse=True)
        pair, first, common = np.unique(number[lead[led]] * len(own) + number[led], return_index=True, return_counts=True)
        at = led[first]
        return pa.table([pa.array(x) for x in (sig[lead[at]], sig[at], n[lead[at]], n[at], common)], schema=_COUNTS)

    return run


_MEMBERS = "column long, sig long, n long, m long, rest long, label long"


def _members(num: int, den: int) -> Callable:
    """(column, set, ...) of the m - t + 1 rarest columns of each set; rest: how many others it has (of two
    sets, what they may have in common beyond these is among the others of the one whose rarest end first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, m, label = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            posted = m - common_least(n, num, den) + 1
            cols = [np.frombuffer(x, "<i8", k) for x, k in zip(batch.column(3).to_pylist(), posted.tolist(), strict=True)]
            if cols:
                each = lambda x: pa.array(np.repeat(x, posted))  # noqa: E731, B023
                yield pa.record_batch({"column": pa.array(np.concatenate(cols)), "sig": each(sig), "n": each(n), "m": each(m), "rest": each(m - posted), "label": each(label)})

    return run


SECOND = COUNTS + ", rest long"
_SECOND = pa.schema([*_COUNTS, ("rest", pa.int64())])


def _second_product(num: int, den: int) -> Callable:
    """Of chunks of columns' lists, two at a time: how many of the columns each two sets of different components have in
    common, if their sizes and bit maps allow a link. Rows without a column bring the maps, one for each set."""

    def run(table: pa.Table) -> pa.Table:
        brings = pc.is_null(table.column("column"))
        maps, table = table.filter(brings), table.filter(pc.invert(brings))
        if not table.num_rows:
            return _SECOND.empty_table()
        names = ("column", "low", "high", "part", "n", "sig", "m", "rest", "label")
        column, low, high, part, n, sig, m, rest, label = (table.column(c).to_numpy() for c in names)
        order = np.lexsort((n, part, high, low, column))
        column, low, high, part, n, sig, m, rest, label = (x[order] for x in (column, low, high, part, n, sig, m, rest, label))
        new = np.append(True, (column[1:] != column[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(column)))
        end = np.repeat(starts + lengths, lengths)
        own, number = np.unique(sig, return_inverse=True)
        known = np.argsort(maps.column("sig").to_numpy())
        raw = maps.column("bits").take(pa.array(known)).to_pylist()
        bits = _Maps(maps.column("n").to_numpy()[known], raw)
        twin = low != high  # of two chunks, only pairs across them
        held, keys, counts = 0, [], []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            least = np.minimum(m[i], m[j])
            fit = (label[i] != label[j]) & (den * least >= num * (n[i] + n[j] - least)) & (num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j]))
            fit &= ~twin[i] | (part[i] != part[j])
            i, j = i[fit], j[fit]
            here, there = bits.only(number[i], number[j])
            least = np.minimum(m[i] - here, m[j] - there)
            fit = den * least >= num * (n[i] + n[j] - least)
            i, j = i[fit], j[fit]
            a, b = np.minimum(number[i], number[j]), np.maximum(number[i], number[j])
            keys.append(a * len(own) + b)
            counts.append(np.ones(len(i), np.int64))
            held += len(i)
            if held > PAIRS_HELD:
                squeeze()

        def squeeze() -> None:
            nonlocal held
            if keys:
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                counts[:] = [np.bincount(back, np.concatenate(counts)).astype(np.int64)]
                keys[:], held = [key], 0

        short = lengths <= 64
        at = np.flatnonzero(np.repeat(short, lengths))
        for step in range(1, 64):  # all short lists at once: each row with the one so many places on
            at = at[at + step < end[at]]
            if not len(at):
                break
            add(at, at + step)
        for s, k in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
            if (label[s : s + k] == label[s]).all():
                continue
            for i in range(s, s + k - 1):
                j = np.arange(i + 1, s + k)
                add(np.full(len(j), i), j)
        squeeze()
        if not keys:
            return _SECOND.empty_table()
        (key,), (common,) = keys, counts
        first = np.zeros(len(own), np.int64)
        first[number] = np.arange(len(number))
        i, j = first[key // len(own)], first[key % len(own)]
        return pa.table([pa.array(x) for x in (sig[i], sig[j], n[i], n[j], common, np.maximum(rest[i], rest[j]))], schema=_SECOND)

    return run


def _wanted_sets(size: int, filled: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, blobs = [], []
            for g in wd.groups(batch.column(1).filter(pa.array(bloom.test(filled, batch.column(0)))), lower=True):
                d, h = shingle_sets(g, size)
                _, s1, _ = _signature(d, h, g.docs)
                low = h & _U(0xFFFFFFFFFFFF)
                raw = np.empty(len(low), [("l", "<u4"), ("h", "<u2")])
                raw["l"], raw["h"] = low & _U(0xFFFFFFFF), low >> _U(32)
                at = np.searchsorted(d, np.arange(g.docs + 1))
                for k in range(g.docs):
                    sig.append(s1[k])
                    blobs.append(raw[at[k] : at[k + 1]].tobytes())
            yield pa.record_batch({"sig": pa.array(sig, pa.int64()), "grams": pa.array(blobs, pa.binary())})

    return run


def _grams(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, [("l", "<u4"), ("h", "<u2")])
    return raw["l"].astype(_U) | raw["h"].astype(_U) << _U(32)


def _product() -> Callable:
    """Overlap counts of a block's pairs: rows of leaders by rows of partners."""

    def run(table: pa.Table) -> pa.Table:
        a, b, blobs = (table.column(c).to_pylist() for c in ("a", "b", "grams"))
        leaders = {x: _grams(g) for x, y, g in zip(a, b, blobs, strict=True) if y is None}
        number = {x: k for k, x in enumerate(leaders)}
        column_of = lambda g, x: wd.mix(g + _U(number[x] * 0x9E3779B97F4A7C15 % (1 << 64)))
        matrix = np.sort(np.concatenate([column_of(g, x) for x, g in leaders.items()] or [np.zeros(0, _U)]))
        pairs = [(x, y, _grams(g)) for x, y, g in zip(a, b, blobs, strict=True) if y is not None and x in leaders]
        out_a, out_b, out_o = [], [], []
        for s in range(0, len(pairs), 256):
            part = pairs[s : s + 256]
            cells = np.concatenate([column_of(g, x) for x, _, g in part])
            at = np.minimum(np.searchsorted(matrix, cells), len(matrix) - 1)
            lengths = np.array([len(g) for _, _, g in part])
            overlap = np.add.reduceat((matrix[at] == cells).astype(np.int64), np.cumsum(lengths) - lengths)
            for (x, y, g), i in zip(part, overlap.tolist(), strict=True):
                out_a.append(x)
                out_b.append(y)
                out_o.append(i)
        return pa.table([pa.array(x, pa.int64()) for x in (out_a, out_b, out_o)], names=["a", "b", "overlap"])

    return run


def _overlaps(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(a, b, overlap) of pairs of sets (a, b: signatures)."""
    ends = pairs.select(F.col("a").alias("s1")).unionByName(pairs.select(F.col("b").alias("s1"))).distinct()
    filled = bloom.build(classes.join(ends, "s1", "left_semi").select("rep"))
    sets = docs.mapInArrow(_wanted_sets(size, filled), "sig long, grams binary")
    sets = cut(sets.join(ends.withColumnRenamed("s1", "sig"), "sig", "left_semi").groupBy("sig").agg(F.first("grams").alias("grams")), "sets")
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
    total = pairs.count()
    blocks = max(1, total // BLOCK_EDGES)
    deal = F.pmod(F.xxhash64("a", "salt"), F.lit(blocks)).alias("block")
    right = (
        pairs.join(degree, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
        .join(sets.withColumnRenamed("sig", "b"), "b")
        .select(deal, "a", "b", "grams")
    )
    left = (
        degree.join(sets.withColumnRenamed("sig", "a"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "grams")
        .select(deal, "a", F.lit(None).cast("long").alias("b"), "grams")
    )
    return right.unionByName(left).groupBy("block").applyInArrow(_product(), "a long, b long, overlap long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): see the module for the method and the defined cases.

    Two documents link when den * |intersection| >= num * |union|.
    """
    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    profile = cut(docs.mapInArrow(_profile(size), PROFILE), "profile")
    rows = profile.where("n >= 0")
    classes = cut(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    count, total = classes.agg(F.count("*"), F.sum("n")).first()
    # at most HOT_SHARE times the mean set size, as the sets' sizes are what is counted
    often = profile.where("n < 0").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") <= -max(HOT_LEAST, count // HOT_SHARE)).toArrow()
    hot, times = often.column("s1").to_numpy().view(_U), -often.column("n").to_numpy()
    hot, salts = np.sort(hot), -(-times[np.argsort(hot)] // HOT_CHUNK)

    def by_sets(filled: np.ndarray | None, blocks: int) -> DataFrame:
        posted = docs.mapInArrow(_postings(size, blocks, hot, num, den, filled), BLOBS)
        return posted.groupBy("block").applyInArrow(_shared(blocks), BLOBS).groupBy("block")

    able = by_sets(None, max(1, round((total or 0) * 3 / 8 / BLOCK_POSTINGS))).applyInArrow(_able(num, den), "s1 long")
    able = cut(classes.join(able, "s1", "left_semi").select("rep", "n"), "able")
    blocks = max(1, round((able.agg(F.sum("n")).first()[0] or 0) / BLOCK_POSTINGS))
    sets = cut(by_sets(bloom.build(able.select("rep")), blocks).applyInArrow(_rows_of_product(num, den), SETS), "sets")

    reaches = lambda common: den * common >= num * (F.col("na") + F.col("nb") - common)
    blocks = max(1, round((sets.agg(F.sum("m")).first()[0] or 0) / BLOCK_POSTINGS))
    first = sets.mapInArrow(_repost(blocks, hot, salts), BLOBS).groupBy("block").applyInArrow(_first_product(num, den), COUNTS)
    first = first.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    links = cut(first.where(reaches(F.col("common"))).select("a", "b"), "links")
    labels = cut(components(links), "labels")

    members = sets.join(labels, F.col("sig") == F.col("node"), "left").select("sig", "n", "m", "columns", F.coalesce("label", "sig").alias("label"))
    members = cut(members.mapInArrow(_members(num, den), _MEMBERS), "members")
    about = members.groupBy("column").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("length"))
    chunks = F.ceil(F.col("length") / CHUNK).cast("int")
    open_ = members.join(about.where("least <> most").select("column", chunks.alias("chunks")), "column")
    part = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")
    open_ = open_.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    open_ = open_.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    deal = F.pmod(F.xxhash64("column", "low", "high"), F.lit(4 * blocks)).alias("block")
    open_ = cut(open_.select(deal, "column", "low", "high", "part", "sig", "n", "m", "rest", "label"), "open")
    maps = open_.select("block", "sig").distinct().join(sets.select("sig", "n", "bits"), "sig")
    second = open_.unionByName(maps, allowMissingColumns=True).groupBy("block").applyInArrow(_second_product(num, den), SECOND)
    second = second.groupBy("a", "b", "na", "nb", "rest").agg(F.sum("common").alias("common"))
    pairs = cut(second.where(reaches(F.col("common") + F.col("rest"))).select("a", "b", "na", "nb"), "pairs")
    if not pairs.isEmpty():
        more = _overlaps(docs, classes, pairs, size).join(pairs, ["a", "b"]).where(reaches(F.col("overlap"))).select("a", "b")
        labels = cut(components(links.unionByName(more)), "labels")

    named = classes.join(labels.withColumnRenamed("node", "s1"), "s1", "left").withColumn("label", F.coalesce("label", "s1"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = cut(named.join(lowest, "label").select("s1", "s2", "n", "component_id"), "named")
    joined = rows.join(final, ["s1", "s2", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
