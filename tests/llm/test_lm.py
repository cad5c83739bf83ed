import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calathea.llm import elias_fano as E
from calathea.llm import lm

from .conftest import lower, words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300, unique=True), st.sampled_from([5001, 10**6, 1 << 45]))
def test_sequences(values, universe):
    v = np.sort(np.array(values, np.int64))
    ef = E.EliasFano(E.encode(v, universe))
    assert (ef.values() == v.astype(np.uint64)).all()
    x = np.arange(0, 5001, 7)
    place = {int(y): k for k, y in enumerate(v)}
    assert ef.find(x).tolist() == [place.get(int(y), -1) for y in x] and ef.find(v).tolist() == list(range(len(v)))


def test_dense_and_repeated_runs():
    v = np.concatenate([np.arange(1000), np.arange(10**9, 10**9 + 3000), [2 * 10**9]])
    ef = E.EliasFano(E.encode(v, 2 * 10**9 + 1))
    assert (ef.find(v) == np.arange(len(v))).all() and (ef.find(np.array([5000, 10**9 - 1, 2 * 10**9 - 1])) == -1).all()


def model_of(corpus):
    texts = [(i, [*words(lower(t)), None]) for i, t, _ in corpus]
    train = [w for i, w in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    one = Counter(w for x in train for w in x)
    two = Counter(p for x in train for p in zip(x, x[1:], strict=False))
    three = Counter(p for x in train for p in zip(x, x[1:], x[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def d(c):
        once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
        return min(lm.MOST_D, max(lm.LEAST_D, once / max(1, once + 2 * twice)))

    d2, d3 = d(two), d(three)
    s2, s3, t3 = Counter(k[0] for k in two), Counter(k[:2] for k in three), Counter()
    for k, c in three.items():
        t3[k[:2]] += c
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    p2 = lambda u, w: max(0, two[u, w] - d2) / one[u] + min(1, d2 * s2[u] / one[u]) * p1(w) if s2[u] else p1(w)

    def p3(t, u, w):
        return max(0, three.get((t, u, w), 0) - d3) / t3[t, u] + min(1, d3 * s3[t, u] / t3[t, u]) * p2(u, w) if s3[t, u] else p2(u, w)

    return texts, train, one, n, v, p1, p2, p3


def test_against_counts(docs, corpus):
    texts, _, one, n, v, p1, p2, p3 = model_of(corpus)
    want = []
    for i, x in texts:
        base = sum(math.log10(p1(w)) for w in x)
        full = sum(math.log10(p1(w) if k == 0 else p2(x[k - 1], w) if k == 1 else p3(x[k - 2], x[k - 1], w)) for k, w in enumerate(x))
        want.append((repr(i), len(x), sum(one[w] > 0 for w in x), base, full, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2))
    got = [(repr(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score, r.held_out) for r in lm.score(docs).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[5] == b[5] and a[3] == pytest.approx(b[3]) and abs(a[4] - b[4]) <= 0.03 * a[1]


def test_split_contexts(docs, corpus, monkeypatch):
    """Contexts split over shards by ranges of successors score as whole ones do."""
    whole = {repr(r.doc_id) + str(r.n_tokens): r.score / r.n_tokens for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 15)
    monkeypatch.setattr(lm, "WORD_SHARD_BYTES", 500)
    monkeypatch.setattr(lm, "SLICE", 3000)
    for r in lm.score(docs).collect():
        assert abs(whole[repr(r.doc_id) + str(r.n_tokens)] - r.score / r.n_tokens) < 1e-9


def test_nothing(spark, nothing):
    assert lm.score(nothing).count() == 0
    held = spark.createDataFrame([(k, "a b") for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.train_tokens, r.base_score, r.score) for r in lm.score(held).collect()} == {(0, 0.0, 0.0)}


def test_probabilities_sum_to_one(corpus):
    _, train, one, _, v, p1, p2, p3 = model_of(corpus)
    x = train[0]
    assert sum(p2(x[0], w) for w in one) + p2(x[0], object()) == pytest.approx(1)
    assert sum(p3(x[0], x[1], w) for w in one) + p3(x[0], x[1], object()) == pytest.approx(1)
