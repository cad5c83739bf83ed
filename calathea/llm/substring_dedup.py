"""Substring dedup: words under a window of `size` words that occurs elsewhere in the corpus, by FM-index shards.

Method. Each window of 35 words picks its least 8-gram by hash as its anchor, so equal windows have equal anchors.
Anchors are dealt into blocks, an anchor that a batch has several times as one entry; those that occur once are done.
Around the others, the passages that their windows cover are routed to the anchor's shard, equal passages once with a
count. A shard is a compressed FM-index (`fm_index`) of its passages. The documents' passages are streamed through it by
backward search, which gives their matching statistics: how far from each word on the text occurs at two places or
more. Where they reach the window's length an interval begins; intervals are reported. Every occurrence of a window
reaches one shard exactly once: passages of a document in a shard are disjoint.
Members of a passage stay with the documents and get the reported runs by a join, so a passage that many documents
share never gathers them in one task. Bloom filters of fixed size only spare the shuffle of texts without findings.

Defined results: null text counts as empty; texts under `size` words keep all their words; equal rows, also with
equal ids, count as documents of their own; a null id keeps its row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import words as wd
from .fm_index import FMIndex
from .shared import column, cut

GRAM = 8
BLOCK_ANCHORS = 1_000_000
SHARD_WORDS = 1_000_000
NO_RANK = (1 << 32) - 1
_U = np.uint64
BLOBS = "block long, blob binary"
_BLOCK = pa.schema([("block", pa.int64()), ("blob", pa.binary())])


def anchors(g: wd.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor, in order: (document, hash, first and last window that pick it, its rank in its document)."""
    span, gram = size - GRAM + 1, wd.rolling(g.hashes, GRAM)
    none = np.zeros(0, np.int64)
    if len(g.hashes) < size:
        return none, none.astype(_U), none, none, none
    at, width = np.arange(len(gram)), 1  # place of the least gram of a growing width, the leftmost of equal ones
    while width < span:
        step = min(width, span - width)
        left = gram[:-step] <= gram[step:]
        gram, at = np.where(left, gram[:-step], gram[step:]), np.where(left, at[:-step], at[step:])
        width += step
    doc = g.doc_of_word()
    windows = np.flatnonzero(doc[: len(at)] == doc[size - 1 :])
    at, least = at[windows], gram[windows]
    new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    d = doc[windows[first]] if len(first) else none
    rank = np.arange(len(first)) - np.searchsorted(d, d)
    return d, least[first], windows[first], windows[last], rank


def _deal(key: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    block = ((key >> _U(32)) * _U(blocks)) >> _U(32)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1).astype(_U))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


def _blocks(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=_BLOCK)


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_rows(size: int, blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hs, rows, ranks = _long(batch.column(0)), [], [], []
            for g in wd.groups(batch.column(1)):
                d, h, _, _, rank = anchors(g, size)
                hs.append(h)
                rows.append(keys[g.row + d])
                ranks.append(rank)
            if hs:
                h, row, rank = wd.mix(np.concatenate(hs)), np.concatenate(rows), np.concatenate(ranks).astype("<u4")
                # anchors that the batch has twice are answered here; one entry without a row tells the others
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                again = np.zeros(len(h), bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                out = [(-1 - int(row[again][0] % blocks), np.stack([row[again], rank[again]]).astype("<i8").tobytes())] if again.any() else []
                marks = np.unique(h[again])
                h, row, rank = np.append(h[~again], marks), np.append(row[~again], np.zeros(len(marks), np.int64)), np.append(rank[~again], np.full(len(marks), NO_RANK, "<u4"))
                for k, at in _deal(h, blocks):
                    at = at[np.argsort(row[at], kind="stable")]
                    own, ref = np.unique(row[at], return_inverse=True)
                    low = h[at] & _U(0xFFFFFFFFFFFF)
                    parts = [np.array([len(at), len(own)], "<i8"), (low & _U(0xFFFFFFFF)).astype("<u4"), (low >> _U(32)).astype("<u2"), ref.astype("<u4" if len(own) > 65535 else "<u2"), own, rank[at].astype("<u4")]
                    out.append((k, b"".join(x.tobytes() for x in parts)))
                yield from _blocks(out).to_batches()

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, "<i8", 2)
    at, out = 16, []
    for kind, k in (("<u4", n), ("<u2", n), ("<u4" if m > 65535 else "<u2", n), ("<i8", m)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    rank = np.frombuffer(blob, "<u4", n, at)
    low, high, ref, own = out
    return low.astype(_U) | high.astype(_U) << _U(32), own[ref], rank.astype(np.int64)


def _repeated(table: pa.Table) -> pa.Table:
    """Of a block of anchors: by document, the ranks of those that occur twice or more."""
    if table.column("block")[0].as_py() < 0:
        row, rank = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in table.column("blob").to_pylist()], axis=1)
        order = np.lexsort((rank, row))
        pair = np.stack([row[order], rank[order]])
    else:
        h, row, rank = (np.concatenate(x) for x in zip(*map(_unpack, table.column("blob").to_pylist()), strict=True))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        often = rank == NO_RANK
        often[order[1:][same]] = often[order[:-1][same]] = True
        known = np.unique(h[rank == NO_RANK])
        often |= np.isin(h, known)
        at = np.flatnonzero(often & (rank != NO_RANK))
        pair = np.unique(np.stack([row[at], rank[at]]), axis=1)
    starts = np.flatnonzero(np.append(True, pair[0, 1:] != pair[0, :-1])) if pair.shape[1] else np.zeros(0, np.int64)
    ranks = [x.astype("<u4").tobytes() for x in np.split(pair[1], starts[1:])] if len(starts) else []
    return pa.table({"key": pa.array(pair[0, starts]), "ranks": pa.array(ranks, pa.binary())})


def _passages(size: int, shards: int) -> Callable:
    """Passages of a document's repeated anchors by shard; equal ones of a batch once, with their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = _long(batch.column(0)), batch.column(2).to_pylist()
            found: dict[tuple[int, int], tuple[bytes, int, list]] = {}
            for g in wd.groups(batch.column(1)):
                d, h, first, last, rank = anchors(g, size)
                bounds = np.searchsorted(d, np.arange(g.docs + 1))
                flat = (g.hashes >> _U(32)).astype("<u4")
                for k in range(g.docs):
                    here = bounds[k] + np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in lists[g.row + k]]))
                    here = here[here < bounds[k + 1]]  # ranks beyond are of another document with this key
                    if not len(here):
                        continue
                    shard = ((wd.mix(h[here]) >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    here, shard = here[order], shard[order]
                    start, end = first[here], last[here] + size
                    new = np.append(True, (shard[1:] != shard[:-1]) | (start[1:] >= end[:-1]))
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], len(here)) - 1
                    for s, a, b in zip(shard[heads].tolist(), start[heads].tolist(), end[tails].tolist(), strict=True):
                        words = flat[a:b].tobytes()
                        name = (s, int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True))
                        found.setdefault(name, (words, []))[1].append((keys[g.row + k], a - int(g.first[k])))
            if found:
                members = [np.array(m, np.int64) for _, m in found.values()]
                yield pa.record_batch({
                    "shard": pa.array([s for s, _ in found], pa.int64()), "passage": pa.array([p for _, p in found], pa.int64()),
                    "words": pa.array([w for w, _ in found.values()], pa.binary()), "count": pa.array([len(m) for m in members], pa.int64()),
                    "members": pa.array([m.tobytes() for m in members], pa.binary()),
                })

    return run


def _search(size: int) -> Callable:
    """One shard: index its passages, stream them through it, report the intervals of repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("words").to_pylist()
        lengths = np.array([len(x) // 4 for x in blobs])
        flat = np.frombuffer(b"".join(blobs), "<u4")
        index = FMIndex(flat, lengths, table.column("count").to_numpy(), size)
        reach, _ = index.matching_statistics(flat, lengths, least=2)
        often = reach >= size
        ends = np.cumsum(lengths)
        edge = np.diff(np.concatenate([[0], often, [0]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        owner = np.searchsorted(ends, first, "right")  # windows don't run across passages, so no run does
        begin = ends - lengths
        have, at = np.unique(owner, return_index=True)
        runs = np.stack([first - begin[owner], last - begin[owner] + size], axis=1).astype("<u4")
        return pa.table({"passage": table.column("passage").combine_chunks().take(pa.array(have)), "runs": pa.array([x.tobytes() for x in np.split(runs, at[1:])] if len(have) else [], pa.binary())})

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, runs) of each member of the passages."""
    for batch in batches:
        keys, out = [], []
        for members, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            run = np.frombuffer(runs, "<u4").reshape(-1, 2)
            for key, at in np.frombuffer(members, np.int64).reshape(-1, 2):
                keys.append(key)
                out.append((run + at).astype("<u4").tobytes())
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), "runs": pa.array(out, pa.binary())})


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(g: wd.Words, drop: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by a space) of each document."""
    data = g.data
    for k in range(g.docs):
        s, e = g.first[k], g.first[k + 1]
        keep = np.flatnonzero(~drop[s:e]) + s
        starts, ends = g.starts[keep], g.ends[keep]
        lengths = ends - starts
        if not len(keep):
            yield e - s, e - s, b""
            continue
        total = int(lengths.sum()) + len(keep) - 1
        out = np.full(total, 32, np.uint8)
        to = np.cumsum(lengths + 1) - lengths - 1
        place = np.repeat(to - starts, lengths) + (src := np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum())))
        out[place] = data[src]
        yield e - s, e - s - len(keep), out.tobytes()


def _finish(filled: np.ndarray | None, texts: bool) -> Callable:
    """Result rows; of a table without runs, only those outside the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if filled is not None:
                batch = batch.filter(pa.array(~bloom.test(filled, batch.column(0))))
            lists = batch.column(3).to_pylist() if filled is None else None
            out = [[], [], []]
            for g in wd.groups(batch.column(2), hashes=False):
                drop = np.zeros(len(g.starts) + 1, np.int32)
                if lists:
                    for k in range(g.docs):
                        if lists[g.row + k]:
                            runs = np.frombuffer(b"".join(lists[g.row + k]), "<u4").reshape(-1, 2).astype(np.int64)
                            np.add.at(drop, g.first[k] + runs[:, 0], 1)
                            np.add.at(drop, g.first[k] + runs[:, 1], -1)
                for n, gone, kept in _kept(g, np.cumsum(drop[:-1]) > 0):
                    out[0].append(n)
                    out[1].append(gone)
                    out[2].append(kept.decode("utf-8", "replace") if texts else hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256"])

    return run


def _outside(filled: np.ndarray, inside: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.test(filled, batch.column(0)) == inside))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, or the kept text): see the module for the method and the cases."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    volume = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, round(volume / 80 / BLOCK_ANCHORS))  # about an anchor in 80 characters
    hashed = rows.select("key", "text").mapInArrow(_anchor_rows(size, blocks), BLOBS)
    repeated = cut(hashed.groupBy("block").applyInArrow(_repeated, "key long, ranks binary"), "anchors")
    count = repeated.agg(F.sum(F.length("ranks") / 4)).first()[0] or 0
    shards = max(1, round(count * 24 / SHARD_WORDS))  # about 48 words each, of which half are of equal passages

    filled = bloom.build(repeated.select("key"))
    by_doc = repeated.groupBy("key").agg(F.collect_list("ranks").alias("ranks"))
    some = rows.select("key", "text").mapInArrow(_outside(filled, True), "key long, text string")
    wanted = some.join(by_doc, "key").select("key", "text", "ranks")
    passages = cut(wanted.mapInArrow(_passages(size, shards), "shard long, passage long, words binary, count long, members binary"), "passages")
    distinct = passages.groupBy("shard", "passage").agg(F.sum("count").alias("count"), F.first("words").alias("words"))
    runs = distinct.groupBy("shard").applyInArrow(_search(size), "passage long, runs binary")
    marks = passages.select("passage", "members").join(runs, "passage").select("members", "runs").mapInArrow(_spread, "key long, runs binary")
    marks = cut(marks.distinct().groupBy("key").agg(F.collect_list("runs").alias("runs")), "marks")

    marked = bloom.build(marks.select("key"))
    result = RESULT.replace("kept_sha256", "kept") if texts else RESULT
    clean = rows.mapInArrow(_finish(marked, texts), result)
    rest = rows.mapInArrow(_outside(marked, True), "key long, doc_id long, text string").join(marks, "key", "left")
    return clean.unionByName(rest.select("key", "doc_id", "text", "runs").mapInArrow(_finish(None, texts), result))
