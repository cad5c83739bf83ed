"""Token ids of texts by a public tokenizer file, for Arrow batches.

The tokenizer drops white space between words, so a text's ids are its words' ids in order: each distinct word is
encoded once and kept in a bounded cache of the worker. `check` compares the two ways on given texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from . import words as wd

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
_U = np.uint64
TABLE_BITS, LOAD = 22, 0.65
JOIN, GROUP = 5_000, 1 << 20
# The split of texts that PLAIN relies on.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of which the split makes a piece of letters, a piece of punctuation, or both in this order (a capital I with
#: a dot lowers to two characters, and apostrophes begin pieces of their own, so those are left out).
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]*)([!-&(-/:-@\[-`{-~]*)")


def pieces_of(word: str) -> int:
    """Pieces of a plain word, 0 of any other."""
    if word.isascii() and word.isalpha():
        return 1
    m = PLAIN.fullmatch(word)
    return bool(m[1]) + bool(m[2]) if m else 0


class WordTable:
    """Open-addressing table from word hashes to numbers in order of insertion."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits, self.mask, self.count = bits, (1 << bits) - 1, 0
        self.keys = np.zeros(1 << bits, _U)
        self.numbers = np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        at, open_ = (h >> _U(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(open_):
            key = self.keys[at]
            hit = key == h[open_]
            out[open_[hit]] = self.numbers[at[hit]]
            go = ~hit & (key != 0)
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes on from the last."""
        number = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            won = free & (self.keys[at] == h)
            self.numbers[at[won]] = number[won]
            h, number, at = h[~won], number[~won], (at[~won] + 1) & self.mask


class Encoder:
    """Ids of whole documents, by way of a cache of words."""

    def __init__(self, path: str = DEFAULT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = "<|startoftext|>", self.tokenizer.token_to_id("<|startoftext|>")
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        split = (about.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.suffix = about["model"].get("end_of_word_suffix") if split == SPLIT else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable()
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.uint8)
        self.flat = np.zeros(0, np.uint16)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, their counts). Plain words go in one text and are told apart by ids
        that end a piece; the others are."""
        if not self.suffix:
            return self._parted(texts)
        each = np.array([pieces_of(x) for x in texts], np.int64)
        plain, pieces = each > 0, each[each > 0]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(x for x, n in zip(texts, each.tolist(), strict=True) if n)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != pieces.sum():
            return self._parted(texts)
        stops = ends[np.cumsum(pieces) - 1] + 1 if len(pieces) else np.zeros(0, np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(stops, prepend=0)
        other, size = self._parted([x for x, n in zip(texts, each.tolist(), strict=True) if not n]) if not plain.all() else (ids[:0], stops[:0])
        counts[~plain] = size
        out = np.empty(len(ids) + len(other), np.int64)
        from_plain = np.repeat(plain, counts)
        out[from_plain], out[~from_plain] = ids, other
        return out, counts

    def _parted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words, a special token between them."""
        if self.mark_id is None or any("<|" in x for x in texts):
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int64), np.array([len(x) for x in found], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join([*texts, ""])], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, h: np.ndarray, g: wd.Words, word: np.ndarray) -> None:
        raw, flat, sizes = g.data.tobytes(), [self.flat], [self.size]
        starts, ends = g.starts[word].tolist(), g.ends[word].tolist()
        for k in range(0, len(h), JOIN):
            ids, size = self._ids([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[k : k + JOIN], ends[k : k + JOIN], strict=True)])
            wide = self.flat.dtype if not len(ids) or ids.max() < 65536 else np.uint32
            flat.append(ids.astype(np.promote_types(wide, self.flat.dtype)))
            if len(size) and size.max() > 255 and self.size.dtype == np.uint8:
                self.size = self.size.astype(np.int64)
                sizes = [x.astype(np.int64) for x in sizes]
            sizes.append(size.astype(self.size.dtype))
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.at = at.astype(np.int32 if len(self.flat) < 1 << 31 else np.int64)
        self.table.add(h)

    def numbers(self, g: wd.Words) -> np.ndarray:
        """The cache's number of each word of the group; numbers of a group hold until the next call."""
        h = np.maximum(g.hashes, _U(1))
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.table.count + len(new) > LOAD * (1 << TABLE_BITS):
                self._clear()
                new = np.arange(len(h))
            distinct, first = np.unique(h[new], return_index=True)
            if len(distinct) > LOAD * (1 << TABLE_BITS):
                self.table = WordTable(int(len(distinct)).bit_length() + 1)
            self._learn(distinct, g, new[first])
            number = self.table.find(h)
        return number

    def encode(self, g: wd.Words, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the group's documents one after another, their counts); `end` is put after each document."""
        number = self.numbers(g)
        size = self.size[number].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(before[g.first])
        ids = self.flat[np.repeat(self.at[number] - before[:-1], size) + np.arange(before[-1])].astype(np.uint32)
        if end is None:
            return ids, counts
        out = np.empty(len(ids) + len(counts), np.uint32)
        stops = np.cumsum(counts + 1) - 1
        inner = np.ones(len(out), bool)
        inner[stops] = False
        out[inner], out[stops] = ids, end
        return out, counts + 1

    def count(self, g: wd.Words, vocabulary: int) -> np.ndarray:
        """How often each id occurs in the group, end ids aside."""
        number, times = np.unique(self.numbers(g), return_counts=True)
        size = self.size[number].astype(np.int64)
        ids = self.flat[np.repeat(self.at[number] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        return np.bincount(ids, np.repeat(times, size), minlength=vocabulary).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch_column: pa.Array, end: int | None, path: str = DEFAULT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first document, ids, counts) for each group of documents of a column."""
    own = encoder(path)
    for g in wd.groups(batch_column, limit=GROUP):
        yield g.row, *own.encode(g, end)


def check(texts: list[str], path: str = DEFAULT) -> bool:
    """Whether the ids equal those of the tokenizer's own run over the whole texts."""
    own = encoder(path)
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, ids, counts in encoded(pa.array(texts, pa.string()), None, path):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
    return got == want
