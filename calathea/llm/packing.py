"""Packing of documents into training windows by sum of squares, online, one packer per partition.

Method. A level array counts the open windows by fill level. Each document goes to the level (or a new window)
that leaves the least sum of squared counts; of longer documents, whole windows are cut off first. What is open when a
partition ends goes on to a second round: the pieces of many partitions, PART_UNITS of them to a packer, are placed by
the same rule, so that small partitions pack as well as large ones. Only what is open at its end is laid together: the
emptiest windows fill the fullest, cut where one gets full, and the last window is cut into powers of two: no sequence
needs padding. A packer that holds MAX_OPEN windows lays two together in that way and goes on with its level array, so
its memory is bounded whatever the lengths are.
Nothing is shuffled: a partition's sequences depend on its rows only, and a retried task makes the same ones.

Defined results: a null text is an empty document, which is its end id alone; repeated rows are packed each;
a null id is kept; an empty table gives no rows. Sequence ids are round * 2**59 + partition * 2**36 + a running number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import column, cut

MAX_OPEN = 8_192
PART_UNITS = 8_000_000
FLUSH_BYTES = 8 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Windows of `size` units; pieces are (document, start, its units in bytes of 4, units of the document)."""

    def __init__(self, size: int, emit: Callable[[list], None]):
        self.size, self.emit = size, emit
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.count = 0

    def best(self, n: int) -> int:
        """The level to fill up by n units, 0 for a new window; ties go to the fuller window."""
        held = self.levels[1 : self.size - n + 1]
        gain = -2 * held + 2
        after = self.levels[1 + n : self.size + 1]
        gain = gain + 2 * after
        if len(gain):
            gain[-1] = -2 * held[-1] + 1  # a window that gets full leaves the array
            gain[held == 0] = np.iinfo(np.int64).max
            k = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[k] <= 2 * self.levels[n] + 1:
                return k + 1
        return 0

    def add(self, doc, ids: bytes, total: int) -> None:
        unit, start = 4 * self.size, 0
        while len(ids) - 4 * start >= unit:
            self.emit([(doc, start, ids[4 * start : 4 * start + unit], total)])
            start += self.size
        if len(ids) > 4 * start:
            self.place(doc, start, ids[4 * start :], total)

    def place(self, doc, start: int, ids: bytes, total: int) -> None:
        """A piece of less than a window."""
        n = len(ids) // 4
        level = self.best(n)
        pieces = self._take(level) if level else []
        pieces.append((doc, start, ids, total))
        self._put(level + n, pieces)
        if self.count >= MAX_OPEN:
            self._lay_together()

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.count -= 1
        return self.open[level].pop()

    def _put(self, level: int, pieces: list) -> None:
        if level == self.size:
            self.emit(pieces)
        elif level:
            self.open[level].append(pieces)
            self.levels[level] += 1
            self.count += 1

    def _split(self, pieces: list, n: int) -> list:
        """n units off the end of a window's pieces."""
        out = []
        while n:
            doc, start, ids, total = pieces.pop()
            left = max(0, len(ids) // 4 - n)
            out.append((doc, start + left, ids[4 * left :], total))
            if left:
                pieces.append((doc, start, ids[: 4 * left], total))
            n -= len(ids) // 4 - left
        return out

    def _lay_together(self) -> None:
        """Fill the fullest open window from the emptiest; what is left of that stays open."""
        full = int(np.flatnonzero(self.levels)[-1])
        target = self._take(full)
        empty = int(np.flatnonzero(self.levels)[0])
        source = self._take(empty)
        n = min(self.size - full, empty)
        target += self._split(source, n)
        self._put(full + n, target)
        self._put(empty - n, source)

    def close(self) -> None:
        """Lay the open windows together and close them all."""
        while self.count > 1:
            self._lay_together()
        if self.count:
            level = int(np.flatnonzero(self.levels)[0])
            pieces = self._take(level)
            while level:
                n = 1 << level.bit_length() - 1
                self.emit(self._split(pieces, n))
                level -= n

    def rest(self) -> list:
        """The pieces of the windows that are open, which are given up."""
        out = [p for level in self.open for window in level for p in window]
        self.__init__(self.size, self.emit)
        return out


_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class _Rows:
    """Sequences as record batches of pieces, numbered on from the partition's first."""

    def __init__(self, round_: int):
        self.number, self.rows, self.held = round_ << 59 | TaskContext.get().partitionId() << 36, [], 0

    def add(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, total, self.number, offset, ids, is_open))
            offset += len(ids) // 4
            self.held += len(ids)
        self.number += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        out = pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[*_NAMES, "is_open"])
        self.rows, self.held = [], 0
        return out


def _pack(size: int, end: int, path: str) -> Callable:
    """Sequences of a partition's documents, and the pieces that are left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(0)
        packer = SumOfSquares(size, out.add)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for row, ids, counts in tokens.encoded(batch.column(1), end, path):
                raw, at = ids.astype("<u4").tobytes(), 0
                for k, n in enumerate(counts.tolist()):
                    packer.add(docs[row + k], raw[4 * at : 4 * (at + n)], n)
                    at += n
                    if out.held > FLUSH_BYTES:
                        yield out.batch()
        for piece in packer.rest():
            out.add([piece], True)
            if out.held > FLUSH_BYTES:
                yield out.batch()
        yield out.batch()

    return run


def _pack_rest(size: int) -> Callable:
    """Sequences of pieces that were left open, to the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(1)
        packer = SumOfSquares(size, out.add)
        for batch in batches:
            for piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                packer.place(*piece)
                if out.held > FLUSH_BYTES:
                    yield out.batch()
        packer.close()
        yield out.batch()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end: int = 1, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Pieces of documents in sequences (columns: PIECES; ids are little-endian unsigned 32-bit integers)."""
    rows = docs.select(column(docs, id_col).cast("long"), column(docs, text_col).cast("string"))
    first = cut(rows.mapInArrow(_pack(size, end, tokenizer), PIECES + ", is_open boolean"), "pieces")
    left = first.where("is_open")
    units = left.agg(F.sum("length")).first()[0] or 0
    rest = left.select("doc_id", "start", "ids", "doc_tokens").coalesce(max(1, units // PART_UNITS))
    rest = rest.mapInArrow(_pack_rest(size), PIECES + ", is_open boolean")
    return first.where("not is_open").unionByName(rest).drop("is_open")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
