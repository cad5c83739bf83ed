import hashlib
from collections import Counter

import numpy as np
import pytest

from calathea.llm import substring_dedup as D
from calathea.llm.fm_index import BitVector, FMIndex, WaveletTree

from .conftest import words


def brute(corpus, size=35):
    texts = [words(t) for _, t, _ in corpus]
    count = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (i, _, _), w in zip(corpus, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_against_counts(docs, corpus, monkeypatch, small):
    if small:
        monkeypatch.setattr(D, "BLOCK_ANCHORS", 40)
        monkeypatch.setattr(D, "SHARD_WORDS", 300)
    assert sorted((tuple(r) for r in D.remove_repeats(docs).collect()), key=repr) == brute(corpus)


def test_nothing(nothing):
    assert D.remove_repeats(nothing).count() == 0


def test_kept_text(docs):
    rows = D.remove_repeats(docs.where("doc_id = 0"), texts=True).collect()
    assert rows[0].kept == " ".join(words(docs.where("doc_id = 0").first().text))


@pytest.mark.parametrize("skew", [0, 1, 2])
def test_wavelet_ranks(skew):
    rng = np.random.default_rng(0)
    s = (rng.random(700) ** (1 + 2 * skew) * 13).astype(np.int64)
    w, at = WaveletTree(s, 14), rng.integers(0, 701, (2, 200))
    c = rng.integers(0, 14, 200)
    assert (w.rank(c, at) == [[(s[:k] == x).sum() for k, x in zip(row, c, strict=True)] for row in at]).all()
    one = WaveletTree(np.zeros(5, np.int64), 1)
    assert one.rank(np.zeros(3, np.int64), np.array([[0, 2, 5]])).tolist() == [[0, 2, 5]]


@pytest.mark.parametrize("size", [1, 2, 5, 8])
@pytest.mark.parametrize("least", [1, 2, 5])
def test_matching_statistics(size, least):
    rng = np.random.default_rng(size)
    lengths = rng.integers(0, 40, 30)
    flat = rng.integers(0, 3, lengths.sum()).astype(np.uint32)
    flat[::17] = 9
    weights = rng.integers(1, 4, 30)
    index = FMIndex(flat, lengths, weights, size)
    count, at = Counter(), 0
    for n, w in zip(lengths, weights, strict=True):
        for long in range(1, size + 1):
            for k in range(at, at + n - long + 1):
                count[tuple(flat[k : k + long])] += w
        at += n
    other = rng.integers(0, 4, lengths.sum()).astype(np.uint32)  # streamed texts that the index doesn't hold
    seen = set()
    for text in (flat, other):
        (got, weight), at = index.matching_statistics(text, lengths, least, 16), 0
        for n in lengths:
            for k in range(at, at + n):
                want = max((x for x in range(1, min(size, at + n - k) + 1) if count[tuple(text[k : k + x])] >= least), default=0)
                assert got[k] == want and weight[k] == (count[tuple(text[k : k + want])] if want else 0)
                seen.add(want)
            at += n
    assert seen == set(range(size + 1)) if size < 8 else len(seen) > 4


def test_the_tree_is_compressed():
    """Bits follow the entropy of the words, not the size of their alphabet."""
    rng = np.random.default_rng(2)
    s = np.minimum(rng.geometric(0.02, 200_000) - 1, 4095)
    p = np.bincount(s) / len(s)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    w = WaveletTree(s, 4096)
    assert 8 * w.nbytes < 1.3 * len(s) * (entropy + 0.6) + 8 * 60 * 4096 and entropy < 8
    bits = rng.random(70_000) < 0.3
    at = np.arange(0, 70_001, 7)
    assert (BitVector(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])[at]).all()


def test_an_anchor_of_many_rows(spark, monkeypatch):
    """A passage that most documents share, over many batches and blocks."""
    monkeypatch.setattr(D, "BLOCK_ANCHORS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        shared = " ".join(f"p{k}" for k in range(50))
        corpus = [(i, f"{'x' * (i % 9)} {shared} " + " ".join(f"u{i}x{k}" for k in range(i % 50)), None) for i in range(120)]
        corpus += [(200 + i, " ".join(f"v{i}x{k}" for k in range(60)), None) for i in range(40)]
        rows = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string").repartition(4)
        assert sorted((tuple(r) for r in D.remove_repeats(rows).collect()), key=repr) == brute(corpus)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
