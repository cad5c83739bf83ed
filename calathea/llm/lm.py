"""Scoring by an n-gram model in an Elias-Fano trie, memory-mapped from files in the shared folder.

Learning. Level 1 is the words: hashes and counts, in shards by hash; a word's id is its rank. Level 2 has all word
pairs, level 3 the successors of each pair. A level's n-grams are counted per batch, dealt to shards by context (of a
context with more than SHARD_TOKENS tokens, by ranges of its successors as well, so a hot context fills several shards)
and written as a trie level: contexts, pointers to their ranges and successors are monotone Elias-Fano sequences, a
successor being stored relative to the rank of its context. When all shards of a level are there, its counts of
n-grams that occur once and twice and the successors of split contexts are summed over the shards, and a second file
of each gets its smoothed probabilities: a byte holds each n-gram's quantised discounted probability, another each
context's backoff weight. Counts come from all training documents; no result depends on how many shards there are.

Model. Interpolated absolute discounting: p(w | c) = max(0, count(cw) - D) / count(c) + b(c) p'(w), p' the model of the
shorter context, b(c) = D * successors(c) / count(c); D = n1 / (n1 + 2 n2) from a level's counts of once and twice. At
the end (count(w) + 1) / (N + V + 1). A stored context's probabilities sum to one but for quantisation. The first word
of a text has no context.

Defined results: a null text is its end token alone; a null id's documents are learned from (an id's crc32 is that of
the empty text); equal rows count each; without training documents N = V = 0; an empty table gives no rows. Ids have 31
bits: a larger vocabulary raises an error.
"""

from __future__ import annotations

import json
import math
import mmap
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .elias_fano import EliasFano, encode
from .shared import column, cut, filesystem, publish, shared_dir

SHARD_TOKENS = 2_000_000
WORD_SHARD_BYTES = 100_000_000
LEAST_D, MOST_D = 0.1, 0.95
FLOOR, STEPS = -12.75, 255
END = wd.mix(np.array([0x656E64], np.uint64))[0]
ORDER = 3
BLOBS = "shard long, blob binary"
_BLOCK = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])
_U = np.uint64
MAPS = 512
HELD_BYTES = 200_000_000
SLICE = 6 << 20


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(log10 * (STEPS / FLOOR)), 0, STEPS).astype(np.uint8)


#: By byte; the last entry, for -1, is that of n-grams and contexts that aren't stored.
_DISCOUNTED = np.append(10.0 ** (np.arange(STEPS + 1) * (FLOOR / STEPS)), 0.0)
_WEIGHT = np.append(_DISCOUNTED[:-1], 1.0)


def to_file(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, aligned, behind a head that names them."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        head[name] = (x.dtype.str, len(x), at)
        raw = x.tobytes()
        raw += bytes(-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)

    def fill(out) -> None:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for x in parts:
            out.write(x)

    publish(uri, fill)


_maps: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()
_held: dict[str, int] = {}


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; of one in a store without maps, held in memory, HELD_BYTES in all."""
    if uri in _maps:
        _maps.move_to_end(uri)
        return _maps[uri]
    if uri.startswith(("file:", "/")):
        with open(filesystem(uri)[1], "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        fs, path = filesystem(uri)
        with fs.open_input_stream(path) as source:
            raw = source.read()
        _held[uri] = len(raw)
    size = int.from_bytes(raw[:8], "little")
    head = json.loads(raw[8 : 8 + size])
    _maps[uri] = {name: np.frombuffer(raw, kind, n, 8 + size + at) for name, (kind, n, at) in head.items()}
    while len(_maps) > 1 and (len(_maps) > MAPS or sum(_held.values()) > HELD_BYTES):
        _held.pop(_maps.popitem(last=False)[0], None)
    return _maps[uri]


@dataclass
class Model:
    """Where the levels are: shards of words with the first id of each, then shards of each further level."""

    folder: str
    bases: np.ndarray
    tokens: int
    vocabulary: int
    shards: dict[int, int]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted distinct word hashes; unknown words have id -1 and count 0."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        n = len(self.bases)
        shard = (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange(n + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = mapped(f"{self.folder}/words-{k:05d}")
            h = hashes[edges[k] : edges[k + 1]]
            if len(own["hash"]):
                at = np.minimum(np.searchsorted(own["hash"], h), len(own["hash"]) - 1)
                hit = np.flatnonzero(own["hash"][at] == h)
                out[edges[k] + hit] = self.bases[k] + at[hit]
                counts[edges[k] + hit] = own["count"][at[hit]]
        return out, counts

    def shard_of(self, level: int, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        parts = np.maximum(1, -(-count // SHARD_TOKENS))
        part = np.minimum(word, self.vocabulary - 1) * parts // max(1, self.vocabulary)
        return (((wd.mix(context.astype(_U) * _U(0x9E3779B97F4A7C15) + part.astype(_U)) >> _U(32)) * _U(self.shards[level])) >> _U(32)).astype(np.int64)

    def grams(self, level: int, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte of the probability, byte of the context's weight) of distinct n-grams, by context; -1: not stored."""
        out = np.full((2, len(word)), -1, np.int16)
        for at, own, rank, place in self._search(level, context, count, word):
            smooth = mapped(own["name"])
            out[1, at[rank >= 0]] = smooth["weight"][rank[rank >= 0]]
            out[0, at[place >= 0]] = smooth["probability"][place[place >= 0]]
        return out[0], out[1]

    def counts(self, level: int, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often n-grams occur: exactly, if above SHARD_TOKENS or if a power of two, else the power above."""
        out = np.zeros(len(word), np.int64)
        for at, own, _, place in self._search(level, context, count, word):
            at, place = at[place >= 0], place[place >= 0]
            out[at] = np.int64(1) << own["log2"][place].astype(np.int64)
            big = np.isin(place, own["big"])
            out[at[big]] = own["big_count"][np.searchsorted(own["big"], place[big])]
        return out

    def _search(self, level: int, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> Iterator[tuple]:
        """By shard: (which n-grams, its arrays, the ranks of their contexts, the places of the n-grams)."""
        shard = self.shard_of(level, context, count, word)
        order = np.argsort(shard.astype(np.uint16) if self.shards[level] <= 1 << 16 else shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards[level] + 1))
        for k in np.flatnonzero(np.diff(edges)):
            at = order[edges[k] : edges[k + 1]]
            own = mapped(f"{self.folder}/level{level}-{k:05d}")
            part = lambda name: EliasFano({x.split(".")[1]: v for x, v in own.items() if x.startswith(name + ".")})  # noqa: E731, B023
            c = context[at]
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            rank = np.repeat(part("context").find(c[new]), np.diff(np.append(new, len(c))))
            place = np.full(len(at), -1, np.int64)
            known = np.flatnonzero((rank >= 0) & (word[at] < self.vocabulary))
            place[known] = part("successor").find(rank[known] * self.vocabulary + word[at[known]])
            yield at, own | {"name": f"{self.folder}/smooth{level}-{k:05d}"}, rank, place


def _stream(g: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end token after each document, document of each)."""
    n = np.diff(g.first) + 1
    out = np.full(int(n.sum()), END, _U)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = g.hashes
    return out, np.repeat(np.arange(g.docs), n)


def _deal(shard: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(total + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays in their narrowest types, compressed."""
    head, parts = [], []
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        head.append((x.dtype.str, len(x)))
        parts.append(x.tobytes())
    raw = b"".join(parts)
    head = json.dumps([head, len(raw)]).encode()
    return len(head).to_bytes(4, "little") + head + pa.compress(raw, "zstd", asbytes=True)


def _expand(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    head, total = json.loads(blob[4 : 4 + size])
    raw, at, out = pa.decompress(blob[4 + size :], total, "zstd", asbytes=True), 0, []
    for kind, n in head:
        out.append(np.frombuffer(raw, kind, n, at).astype(_U if kind[-1] == "8" else np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return out


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=_BLOCK)


def _count_words(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(_stream(g)[0], return_counts=True) for g in wd.groups(batch.column(0), lower=True)]
            if parts:
                h, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                count = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
                shard = (((h >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)
                yield _rows([(k, len(at).to_bytes(8, "little") + h[at].tobytes() + _squeeze(count[at])) for k, at in _deal(shard, shards)])

    return run


def _write_words(folder: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        shard, hs, cs = table.column("shard")[0].as_py(), [], []
        for blob in table.column("blob").to_pylist():
            n = int.from_bytes(blob[:8], "little")
            hs.append(np.frombuffer(blob, _U, n, 8))
            cs.append(_expand(blob[8 + 8 * n :])[0].astype(np.int64))
        h, back = np.unique(np.concatenate(hs), return_inverse=True)
        count = np.bincount(back, np.concatenate(cs)).astype(np.int64)
        to_file(f"{folder}/words-{shard:05d}", {"hash": h, "count": count.astype(np.uint32 if count.max() < 1 << 32 else np.uint64)})
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(count.sum())], pa.int64())})

    return run


def _numbered(model: Model, g: wd.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, document, count) of each token of a group, ends included; unknown words have the vocabulary's size as id."""
    h, doc = _stream(g)
    h, back = np.unique(h, return_inverse=True)
    ids, counts = model.ids(h)
    ids[ids < 0] = model.vocabulary
    return ids[back], doc, counts[back]


def _pairs(ids: np.ndarray, doc: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of second words, distinct pairs, which of them each is) of a document's words after a known one."""
    at = np.flatnonzero((doc[1:] == doc[:-1]) & (ids[:-1] < unknown)) + 1
    key, back = np.unique(ids[at - 1] << 32 | ids[at], return_inverse=True)
    return at, key, back


def _triples(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of third words, distinct triples, which of them each is); a triple is the number of its pair and a word."""
    own = np.full(len(ids), -1, np.int64)
    own[at] = back
    third = np.flatnonzero((own[:-1] >= 0) & (doc[1:] == doc[:-1])) + 1
    key, back = np.unique(own[third - 1] << 32 | ids[third], return_inverse=True)
    return third, key, back


def _split_counts(model: Model, pair: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Counts of pairs as contexts: 1 where the counts of their words rule out that ranges split them."""
    count = np.ones(len(pair), np.int64)
    ask = np.flatnonzero(np.minimum(before, after) > SHARD_TOKENS)
    if len(ask):
        count[ask] = model.counts(2, pair[ask] >> 32, before[ask], pair[ask] & 0xFFFFFFFF)
    return count


def _with_markers(model: Model, context: np.ndarray, word: np.ndarray, times: np.ndarray, bound: np.ndarray):
    """N-grams, by context, and for each range of a split context its first word with a count of 0: so the context is
    known in every shard of its ranges, and its weight is found where none of its successors are."""
    at = np.flatnonzero((bound > SHARD_TOKENS) & np.append(True, context[1:] != context[:-1])) if len(context) else context
    if not len(at):
        return context, word, times, bound
    parts = -(-bound[at] // SHARD_TOKENS)
    own = np.repeat(at, parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.minimum(-(-nth * model.vocabulary // np.repeat(parts, parts)), model.vocabulary - 1)
    spot = np.append(np.arange(len(context)), own)
    order = np.argsort(spot, kind="stable")
    return context[spot][order], np.append(word, first)[order], np.append(times, np.zeros(len(own), np.int64))[order], bound[spot][order]


def _count_grams(model: Model, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (g for batch in batches for g in wd.groups(batch.column(0), lower=True, limit=SLICE)):
            ids, doc, counts = _numbered(model, g)
            at, pair, back = _pairs(ids, doc, model.vocabulary)
            if not len(at):
                continue
            before, after = np.zeros((2, len(pair)), np.int64)
            before[back], after[back] = counts[at - 1], counts[at]
            if level == 2:
                context, word, times, bound = pair >> 32, pair & 0xFFFFFFFF, np.bincount(back), before
            else:
                _, key, again = _triples(ids, doc, at, back)
                own, word, times = key >> 32, key & 0xFFFFFFFF, np.bincount(again)
                context, bound = pair[own], _split_counts(model, pair, before, after)[own]
            context, word, times, bound = _with_markers(model, context, word, times, bound)
            out = []
            for k, own in _deal(model.shard_of(level, context, bound, word), model.shards[level]):
                c = context[own]
                heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                w, split = word[own], heads[bound[own[heads]] > SHARD_TOKENS]
                out.append((k, _squeeze(np.diff(c[heads], prepend=0), np.diff(np.append(heads, len(c))), w & 0xFFFF, w >> 16 & 0xFF, w >> 24, times[own], c[split], bound[own[split]])))
            if out:
                yield _rows(out)

    return run


LEVEL = "shard long, n long, once long, twice long, split array<struct<context: long, successors: long>>"


def _write_grams(model: Model, level: int) -> Callable:
    """One shard of a level: merge the counts and write its sequences, with the counts that smoothing takes."""

    def run(table: pa.Table) -> pa.Table:
        shard, cs, ws, ts, whole = table.column("shard")[0].as_py(), [], [], [], {}
        for blob in table.column("blob").to_pylist():
            step, n, low, mid, high, times, split, count = (x.astype(np.int64) for x in _expand(blob))
            cs.append(np.repeat(np.cumsum(step), n))
            ws.append(low | mid << 16 | high << 24)
            ts.append(times)
            whole.update(zip(split.tolist(), count.tolist(), strict=True))
        c, w, t = (np.concatenate(x) for x in (cs, ws, ts))
        order = np.lexsort((w, c))
        c, w, t = c[order], w[order], t[order]
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
        t = np.add.reduceat(t, first)
        c, w = c[first], w[first]
        heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        rank = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(c))))
        sizes = np.add.reduceat((t > 0).astype(np.int64), heads)
        # a context's successors in this shard are all of them, unless its count is so large that ranges split it
        split = np.searchsorted(c[heads], np.array(sorted(whole), np.int64))
        arrays = {f"context.{k}": v for k, v in encode(c[heads], int(c[-1]) + 1).items()}
        arrays |= {f"pointer.{k}": v for k, v in encode(np.append(heads, len(c)), len(c) + 1).items()}
        arrays |= {f"successor.{k}": v for k, v in encode(rank * model.vocabulary + w, len(heads) * model.vocabulary).items()}
        arrays["few"] = np.minimum(t, 255).astype(np.uint8)
        arrays["many"] = t[t >= 255]
        arrays["split"], arrays["split_total"] = split, np.array([whole[k] for k in sorted(whole)], np.int64)
        if level < ORDER:
            arrays["log2"] = np.ceil(np.log2(np.maximum(t, 1))).astype(np.uint8)
            arrays["big"] = np.flatnonzero(np.int64(1) << arrays["log2"].astype(np.int64) > SHARD_TOKENS)  # no split by a count rounded up
            arrays["big_count"] = t[arrays["big"]]
        to_file(f"{model.folder}/level{level}-{shard:05d}", arrays)
        kind = pa.list_(pa.struct([("context", pa.int64()), ("successors", pa.int64())]))
        parts = [{"context": c[heads[k]], "successors": sizes[k]} for k in split]
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([int((t > 0).sum())], pa.int64()), "once": pa.array([int((t == 1).sum())]), "twice": pa.array([int((t == 2).sum())]), "split": pa.array([parts], kind)})

    return run


def discount(once: int, twice: int) -> float:
    return min(MOST_D, max(LEAST_D, once / max(1, once + 2 * twice)))


def _smooth(model: Model, level: int, d: float) -> Callable:
    """A second file of each shard: the probabilities and weights of its n-grams. Rows: shard, its split contexts and
    how many successors they have in all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = mapped(f"{model.folder}/level{level}-{shard:05d}")
                heads = EliasFano({k.split(".")[1]: v for k, v in own.items() if k.startswith("pointer.")}).values().astype(np.int64)
                t = own["few"].astype(np.int64)
                t[t == 255] = own["many"]
                rank = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
                sizes, total = np.add.reduceat((t > 0).astype(np.int64), heads[:-1]), np.add.reduceat(t, heads[:-1])
                total[own["split"]] = own["split_total"]
                if split:
                    sizes[own["split"]] = [r["successors"] for r in sorted(split, key=lambda r: r["context"])]
                to_file(f"{model.folder}/smooth{level}-{shard:05d}", {"probability": np.where(t > 0, quantised(np.log10(np.maximum(t - d, 1e-9) / total[rank])), STEPS).astype(np.uint8), "weight": quantised(np.log10(np.minimum(1, d * sizes / total)))})
            yield batch.select([0])

    return run


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, g in ((batch, g) for batch in batches for g in wd.groups(batch.column(2), lower=True, limit=SLICE)):
            ids, doc, counts = _numbered(model, g)
            n = g.docs
            p = (counts + 1) / (model.tokens + model.vocabulary + 1)
            base = np.log10(p)
            at, pair, back = _pairs(ids, doc, model.vocabulary)
            if len(at):
                before, after = np.zeros((2, len(pair)), np.int64)
                before[back], after[back] = counts[at - 1], counts[at]
                code, weight = model.grams(2, pair >> 32, before, pair & 0xFFFFFFFF)
                p[at] = p[at] * _WEIGHT[weight][back] + _DISCOUNTED[code][back]
                third, key, again = _triples(ids, doc, at, back)
                if len(third):
                    own = key >> 32
                    code, weight = model.grams(3, pair[own], _split_counts(model, pair, before, after)[own], key & 0xFFFFFFFF)
                    p[third] = p[third] * _WEIGHT[weight][again] + _DISCOUNTED[code][again]
            log10 = np.log10(p)
            total = lambda x: np.bincount(doc, x, minlength=n)
            yield pa.record_batch({
                "doc_id": batch.column(0).slice(g.row, n), "held_out": batch.column(1).slice(g.row, n), "n_tokens": pa.array(np.bincount(doc, minlength=n)), "n_known": pa.array(total(counts > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, model.tokens)), "base_score": pa.array(total(base)), "score": pa.array(total(log10)),
            })

    return run


def train(texts: DataFrame, folder: str) -> Model:
    """Learn from a table of one text column; the levels' files go below `folder`."""
    volume = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(volume / WORD_SHARD_BYTES))
    words = texts.mapInArrow(_count_words(shards), BLOBS).groupBy("shard").applyInArrow(_write_words(folder), "shard long, n long, tokens long")
    sizes, tokens = np.zeros(shards, np.int64), 0
    for r in cut(words, "lm").collect():  # a row a shard
        sizes[r.shard], tokens = r.n, tokens + r.tokens
    for k in np.flatnonzero(sizes == 0):
        to_file(f"{folder}/words-{k:05d}", {"hash": np.zeros(0, _U), "count": np.zeros(0, np.uint32)})
    model = Model(folder, np.cumsum(sizes) - sizes, tokens, int(sizes.sum()), {})
    if model.vocabulary >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    for level in range(2, ORDER + 1):
        model.shards[level] = max(1, math.ceil(tokens / SHARD_TOKENS))
        grams = cut(texts.mapInArrow(_count_grams(model, level), BLOBS).groupBy("shard").applyInArrow(_write_grams(model, level), LEVEL), "lm")
        once, twice = grams.agg(F.sum("once"), F.sum("twice")).first()
        parts = grams.select("shard", F.explode("split").alias("s")).select("shard", "s.*")
        sums = parts.groupBy("context").agg(F.sum("successors").alias("successors"))
        split = parts.select("shard", "context").join(sums, "context").groupBy("shard").agg(F.collect_list(F.struct("context", "successors")).alias("split"))
        smooth = grams.select("shard").join(split, "shard", "left").mapInArrow(_smooth(model, level, discount(once or 0, twice or 0)), "shard long")
        written = {r.shard for r in cut(smooth, "lm").collect()}
        for k in set(range(model.shards[level])) - written:
            nothing = encode(np.zeros(0, np.int64), 1)
            to_file(f"{folder}/level{level}-{k:05d}", {f"{name}.{x}": v for name in ("context", "successor") for x, v in nothing.items()})
            to_file(f"{folder}/smooth{level}-{k:05d}", {name: np.zeros(0, np.uint8) for name in ("probability", "weight")})
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from the others' folds."""
    spark: SparkSession = docs.sparkSession
    doc_id = column(docs, id_col)
    fold = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(doc_id.cast("long").alias("doc_id"), fold.alias("held_out"), column(docs, text_col).cast("string").alias("text"))
    model = train(rows.where("not held_out").select("text"), shared_dir(spark, "trie"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
