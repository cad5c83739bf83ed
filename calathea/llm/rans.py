"""Token ids in files coded by a static range asymmetric numeral system (rANS).

Folder: table.rtab, one frequency table that all files share, and part-NNNNN.rans files in ascending order of id.
A file is independent blocks, then an index and a trailer. A block codes up to BLOCK ids in LANES interleaved
states of 64 bits, renormalised by 32-bit words; its index entry holds the place, counts, checksums of the words and
of the ids, and checkpoints (step, word, all states) from which decoding may begin within it. So blocks, and halves
of blocks, decode in parallel: a file is read by several tasks, each from a checkpoint on, which give the documents
that begin in their segments. The index also lists the documents (id, count of ids, whether the id is null).

    table:   "RTAB" u32 vocabulary, u32 precision, vocabulary x u32 frequencies, u32 crc32 of all before
    file:    blocks ... index (JSON head and arrays) u64 length of the index, u32 crc32 of the index, "RANS"

Defined results: a null text is an empty document; equal ids follow each other by their token ids; a null id comes first and
stays null; an empty table gives a folder with a table and no rows. A damaged block raises ValueError.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .shared import column, cut, filesystem, publish

LANES, BLOCK, PRECISION = 2_048, 1 << 19, 20
LOWEST = 1 << 31
FILE_IDS, UNIT_IDS, MOST_TASKS = 1 << 22, 1 << 21, 20_000
_U = np.uint64


def scaled(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to 2**precision, at least 1 for each id that occurs."""
    total, room = int(counts.sum()), 1 << precision
    if not total:
        return counts.astype(np.uint32)
    if int((counts > 0).sum()) > room:
        raise ValueError("more ids occur than the precision can hold")
    out = np.where(counts > 0, np.maximum(1, np.round(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    while gap := room - int(out.sum()):
        can = order[out[order] > 1] if gap < 0 else order[:1]
        if gap < 0:
            cut_ = np.minimum(out[can] - 1, np.maximum(1, (out[can] * (-gap / out[can].sum())).astype(np.int64)))
            cut_ = np.where(np.cumsum(cut_) <= -gap, cut_, np.maximum(0, -gap - np.cumsum(cut_) + cut_))
            out[can] -= cut_
        else:
            out[can] += gap
    return out.astype(np.uint32)


class Coder:
    """Encoder and decoder of blocks under one frequency table."""

    def __init__(self, frequencies: np.ndarray, precision: int = PRECISION):
        self.precision = precision
        self.freq = frequencies.astype(_U)
        self.start = (np.cumsum(frequencies, dtype=np.int64) - frequencies).astype(_U)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray, lanes: int = LANES, checkpoints: int = 1) -> tuple[np.ndarray, list[dict]]:
        """(words, checkpoints in order of steps; the first is the start)."""
        steps = -(-len(ids) // lanes)
        marks = {steps * k // (checkpoints + 1) for k in range(checkpoints + 1)}
        x, out, saved = np.full(lanes, LOWEST, _U), [None] * steps, {}
        shift, p = _U(31 - self.precision + 32), _U(self.precision)
        for t in reversed(range(steps)):
            s = ids[t * lanes : (t + 1) * lanes]
            live = x[: len(s)]
            f = self.freq[s]
            big = live >= f << shift
            out[t] = (live[big] & _U(0xFFFFFFFF)).astype("<u4")
            live[big] >>= _U(32)
            q = live // f
            live[:] = (q << p) + (live - q * f) + self.start[s]
            if t in marks:
                saved[t] = x.copy()
        at = np.concatenate([[0], np.cumsum([len(w) for w in out])]) if steps else np.zeros(1, np.int64)
        words = np.concatenate(out) if steps else np.zeros(0, "<u4")
        return words, [{"step": t, "word": int(at[t]), "states": saved[t]} for t in sorted(saved)]

    def decode(self, words: np.ndarray, count: int, lanes: int, checkpoint: dict) -> np.ndarray:
        """The ids from a checkpoint up to the count-th of the block, which is its last or the last of a step."""
        x, at, first = checkpoint["states"].astype(_U).copy(), checkpoint["word"], checkpoint["step"]
        out = np.empty(count - first * lanes, np.uint32)
        low, p = _U((1 << self.precision) - 1), _U(self.precision)
        for t in range(0, len(out), lanes):
            live = x[: len(out) - t]
            slot = live & low
            s = self.symbol[slot]
            out[t : t + lanes] = s
            live[:] = self.freq[s] * (live >> p) + slot - self.start[s]
            need = np.flatnonzero(live < LOWEST)
            live[need] = live[need] << _U(32) | words[at : at + len(need)]
            at += len(need)
        return out


def table_bytes(frequencies: np.ndarray, precision: int = PRECISION) -> bytes:
    raw = b"RTAB" + struct.pack("<II", len(frequencies), precision) + frequencies.astype("<u4").tobytes()
    return raw + struct.pack("<I", zlib.crc32(raw))


def read_table(raw: bytes) -> Coder:
    if raw[:4] != b"RTAB" or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("damaged frequency table")
    size, precision = struct.unpack("<II", raw[4:12])
    return Coder(np.frombuffer(raw, "<u4", size, 12), precision)


class FileWriter:
    """Writes documents' ids to a stream; memory holds one block."""

    def __init__(self, out, coder: Coder):
        self.out, self.coder, self.at = out, coder, 0
        self.held, self.count, self.blocks = [], 0, []
        self.docs, self.sizes = [], []

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= BLOCK:
            flat = np.concatenate(self.held)
            while len(flat) >= BLOCK:
                self._block(flat[:BLOCK])
                flat = flat[BLOCK:]
            self.held, self.count = [flat.copy()], len(flat)

    def _block(self, ids: np.ndarray) -> None:
        words, marks = self.coder.encode(ids, LANES)
        states = np.concatenate([m["states"] for m in marks]).astype("<u8").tobytes()
        raw = states + words.astype("<u4").tobytes()
        self.blocks.append({"at": self.at, "bytes": len(raw), "ids": len(ids), "lanes": LANES, "marks": [(m["step"], m["word"]) for m in marks], "crc": zlib.crc32(raw), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())})
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(flat):
            self._block(flat)
        head = json.dumps({"blocks": self.blocks, "docs": len(self.docs)}).encode()
        null = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        arrays = zlib.compress(ids.tobytes() + np.array(self.sizes, "<i8").tobytes() + null.tobytes(), 1)
        index = struct.pack("<I", len(head)) + head + arrays
        self.out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + b"RANS")


class FileReader:
    """Reads a file of ids: the index at once, blocks as asked."""

    def __init__(self, source, size: int, coder: Coder):
        self.source, self.coder = source, coder
        source.seek(size - 16)
        length, crc = struct.unpack("<QI", (tail := source.read(16))[:12])
        source.seek(size - 16 - length)
        index = source.read(length)
        if tail[12:] != b"RANS" or zlib.crc32(index) != crc:
            raise ValueError("damaged index")
        (head,) = struct.unpack("<I", index[:4])
        about = json.loads(index[4 : 4 + head])
        self.blocks, n = about["blocks"], about["docs"]
        arrays = zlib.decompress(index[4 + head :])
        self.docs, self.sizes, self.null = np.frombuffer(arrays, "<i8", n), np.frombuffer(arrays, "<i8", n, 8 * n), np.frombuffer(arrays, np.uint8, n, 16 * n)

        # segments: (block, its checkpoint, first id in the block, the one after the last)
        self.segments = []
        for k, b in enumerate(self.blocks):
            stops = [step * b["lanes"] for step, _ in b["marks"][1:]] + [b["ids"]]
            self.segments += [(k, c, b["marks"][c][0] * b["lanes"], stop) for c, stop in enumerate(stops)]
        self._raw: tuple[int, bytes] = (-1, b"")
        self._whole: tuple[int, int, int] = (-1, -1, 0)

    def _block(self, k: int) -> bytes:
        if self._raw[0] != k:
            b = self.blocks[k]
            self.source.seek(b["at"])
            raw = self.source.read(b["bytes"])
            if zlib.crc32(raw) != b["crc"]:
                raise ValueError(f"damaged block {k}")
            self._raw = k, raw
        return self._raw[1]

    def segment(self, j: int) -> np.ndarray:
        """Ids of a segment. The words' checksum is checked, and that of a block's ids when all its segments have come."""
        k, c, start, stop = self.segments[j]
        b, raw = self.blocks[k], self._block(k)
        lanes, n = b["lanes"], len(b["marks"])
        states = np.frombuffer(raw, "<u8", n * lanes).reshape(n, lanes)
        step, word = b["marks"][c]
        ids = self.coder.decode(np.frombuffer(raw, "<u4", offset=8 * n * lanes), stop, lanes, {"step": step, "word": word, "states": states[c]})
        block, last, crc = self._whole
        if not c or (block, last) == (k, c - 1):
            self._whole = k, c, zlib.crc32(ids.astype("<u4").tobytes(), crc if c else 0)
            if c == n - 1 and self._whole[2] != b["ids_crc"]:
                raise ValueError(f"block {k} decodes to other ids")
        return ids

    def block(self, k: int, checkpoint: int = 0) -> np.ndarray:
        """Ids of block k from one of its checkpoints on."""
        return np.concatenate([self.segment(j) for j, x in enumerate(self.segments) if x[0] == k and x[1] >= checkpoint])

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of its first id in the file, ids) of each document that begins in segments first:last; memory holds a
        document and a block."""
        edges = np.concatenate([[0], np.cumsum([stop - start for _, _, start, stop in self.segments])])
        begin, end = int(edges[first]), int(edges[len(self.segments) if last is None else last])
        starts = np.cumsum(self.sizes) - self.sizes
        here = np.flatnonzero((starts >= begin) & (starts < end))
        rest, at, j = np.zeros(0, np.uint32), begin, first  # rest: ids from `at` on
        for k in here.tolist():
            start, size = int(starts[k]), int(self.sizes[k])
            parts, have = [rest], at + len(rest)
            while have < start + size:
                parts.append(self.segment(j))
                have += len(parts[-1])
                j += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if self.null[k] else int(self.docs[k]), start, flat[start - at : start - at + size]
            rest, at = flat[start - at + size :], start + size


CODED = "doc_id long, ids binary"


def _width(path: str, end: int) -> str:
    """The narrowest type that holds all ids."""
    return "<u2" if max(tokens.encoder(path).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def _encode(path: str, end: int) -> Callable:
    """(id, ids) of each document, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _width(path, end)
        size = np.dtype(kind).itemsize
        for batch in batches:
            for row, ids, counts in tokens.encoded(batch.column(1), end, path):
                at = np.concatenate([[0], np.cumsum(counts) * size]).astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids.astype(kind))])
                yield pa.record_batch([batch.column(0).slice(row, len(counts)), raw], names=["doc_id", "ids"])

    return run


def _counts(path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = _width(path, end), np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.record_batch({"token": pa.array(at), "n": pa.array(total[at])})

    return run


def _write(folder: str, path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(f"{folder}/table.rtab")
        with fs.open_input_stream(at) as f:
            coder = read_table(f.read())
        kind, part = _width(path, end), TaskContext.get().partitionId()
        name, about = f"{folder}/part-{part:05d}.rans", {}

        def fill(out) -> None:
            writer = FileWriter(out, coder)
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(doc, np.frombuffer(ids.as_buffer(), kind).astype(np.uint32))
            writer.close()
            about.update(docs=len(writer.docs), ids=int(sum(writer.sizes)), segments=sum(len(b["marks"]) for b in writer.blocks))

        publish(name, fill)
        numbers = [pa.array([about[k]], pa.int64()) for k in ("docs", "ids", "segments")]
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([name]), *numbers], names=["part", "path", "docs", "ids", "segments"])

    return run


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Write the table's ids below `folder`; returns the files (part, path, docs, ids, segments), a row each.

    Texts are encoded once, where they lie; only their ids are sorted."""
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    # a number for each row, lasting as it is written: rows without an id, or with one id, can part into several files
    coded = cut(rows.mapInArrow(_encode(tokenizer, end), CODED).withColumn("row", F.monotonically_increasing_id()), "ids")
    found = coded.select("ids").mapInArrow(_counts(tokenizer, end), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(max(found.column("token").to_pylist(), default=end)) + 1, np.int64)  # a row for each id of the vocabulary at most
    counts[found.column("token").to_numpy()] = found.column("n").to_numpy()
    publish(f"{folder}/table.rtab", lambda out: out.write(table_bytes(scaled(counts))))
    parts = max(1, -(-int(counts.sum()) // FILE_IDS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("row")]
    ordered = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    return cut(ordered.mapInArrow(_write(folder, tokenizer, end), "part long, path string, docs long, ids long, segments long"), "rans")


def _read(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(f"{folder}/table.rtab")
        with fs.open_input_stream(at) as f:
            coder = read_table(f.read())
        for batch in batches:
            for name, base, first, last in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                fs, at = filesystem(name)
                with fs.open_input_file(at) as f:
                    rows, held = [], 0
                    for doc, start, ids in FileReader(f, f.size(), coder).documents(first, last):
                        rows.append((doc, base + start, ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held > 2 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    d, s, i = zip(*rows, strict=True)
    return pa.record_batch({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "ids": pa.array(i, pa.binary())})


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the files that write_ids returned, in units of about UNIT_IDS ids, each from a checkpoint on.

    Where a file's ids start is summed up over groups of files and then within each, so no task sees all files."""
    rows = files.withColumn("grp", F.floor(F.col("part") / 1_024))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("grp").agg(F.sum("ids").alias("ids")).select("grp", before(W.orderBy("grp")).alias("base"))
    placed = rows.withColumn("own", before(W.partitionBy("grp").orderBy("part"))).join(groups, "grp")
    units = F.least(F.greatest(F.lit(1), F.col("segments")), F.greatest(F.lit(1), F.ceil(F.col("ids") / UNIT_IDS)))
    placed = placed.withColumn("units", units).withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    edge = lambda k: F.floor((F.col("unit") + k) * F.col("segments") / F.col("units")).cast("long")
    placed = cut(placed.select("path", (F.col("base") + F.col("own")).alias("start"), edge(0).alias("first"), edge(1).alias("last")), "units")
    parts = max(1, min(MOST_TASKS, placed.count()))
    return placed.repartition(parts, "path", "first").mapInArrow(_read(folder), "doc_id long, start long, ids binary")
