import random

import numpy as np
import pytest

from calathea.llm import jaccard_join as J
from calathea.llm.graph import components

from .conftest import lower, words


def brute(corpus):
    sets = []
    for _, t, _ in corpus:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _, _) in enumerate(corpus):
        groups.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _, _) in enumerate(corpus):
        ids = [x for x in groups[find(k)] if x is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_against_all_pairs(docs, corpus):
    assert sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr) == brute(corpus)


def test_many_small_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_POSTINGS", 200)
    monkeypatch.setattr(J, "BLOCK_EDGES", 3)
    monkeypatch.setattr(J, "CHUNK", 4)
    monkeypatch.setattr(J, "POSTINGS_HELD", 500)
    monkeypatch.setattr(J, "PAIRS_HELD", 50)
    monkeypatch.setattr(J, "HOT_LEAST", 5)
    monkeypatch.setattr(J, "HOT_CHUNK", 3)
    assert sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr) == brute(corpus)


def test_bit_maps_bound_what_a_set_lacks():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (3, 40, 47, 60, 64, 65, 300, 380, 400, 3000, 4000)]
    sets = [np.unique(np.concatenate([x, sets[max(0, k - 1)][: len(x) // 2]])) for k, x in enumerate(sets)]
    n = np.array([len(x) for x in sets])
    maps = J._Maps(n, [J._bit_map(x, int(k)).tobytes() for x, k in zip(sets, J._map_size(n), strict=True)])
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(len(sets)) if 75 * max(n[i], n[j]) <= 100 * min(n[i], n[j])])
    a, b = maps.only(pairs[:, 0], pairs[:, 1])
    for (i, j), x, y in zip(pairs.tolist(), a.tolist(), b.tolist(), strict=True):
        lacks = len(np.setdiff1d(sets[i], sets[j]))
        assert lacks * 0.4 - 3 <= x <= lacks and y <= len(np.setdiff1d(sets[j], sets[i]))


def test_nothing(nothing):
    assert J.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_sets_of_all_sizes(spark, monkeypatch, small):
    """Sets of 100 to 10,000 shingles around the threshold, against all pairs."""
    if small:
        for name, value in (("BLOCK_POSTINGS", 3_000), ("CHUNK", 3), ("HOT_LEAST", 3), ("HOT_CHUNK", 2)):
            monkeypatch.setattr(J, name, value)
    rnd, corpus = random.Random(7), []
    for n in (1, 3, 20, 100, 300, 1_000, 4_000, 10_000):
        base = [f"w{rnd.getrandbits(40)}" for _ in range(n + 4)]
        for k in range(7):  # a change spoils up to five shingles
            w = list(base)
            for at in rnd.sample(range(len(w)), round(len(w) * k * 0.007)):
                w[at] = f"x{rnd.getrandbits(40)}"
            corpus.append((len(corpus), " ".join(w[: len(w) - rnd.randint(0, n // 12)]), None))
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr)
    assert got == brute(corpus) and 10 < len({r[2] for r in got}) < 45


def test_filter_keeps_linked_sets():
    """Two sets that link have prefix_least common columns among their first ones, whatever the order."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        common, more, less = rng.integers(1, 400), rng.integers(0, 130), rng.integers(0, 130)
        if 100 * common < 75 * (common + more + less):
            continue
        order = rng.permutation(common + more + less)
        x, y = np.sort(order[: common + more]), np.sort(np.concatenate([order[:common], order[common + more :]]))
        first = lambda s: s[: len(s) - J.common_least(np.array(len(s)), 75, 100) + J.prefix_least(np.array(len(s)))]
        both = np.intersect1d(first(x), first(y))
        for s in (x, y):
            assert len(both) >= J.prefix_least(J.common_least(np.array(len(s)), 75, 100))


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 30)], [(i, 29 - i) for i in range(30)] + [(3, 7), (7, 9)]])
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in range(40):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    edges = [e for e in edges if e[0] != e[1]]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in root.items() if any(k in e for e in edges)}


def test_links_inside_a_component_reach_sets_alike(spark):
    """B has the shared columns of A and more of its own; only X, never multiplied with A in the rounds, links to it."""
    c, own = [f"c{k}" for k in range(1, 111)], iter(f"p{k}" for k in range(10**6))
    private = lambda k: [next(own) for _ in range(k)]
    boiler = [f"d{k}" for k in range(60)] + c[92:]
    sets = [c, c + private(1), c[:92] + private(8), c[:92] + private(26), c[:91] + private(1), *(boiler + private(1) for _ in range(10))]
    rows = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(sets)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in J.jaccard_components(rows, size=1).collect()}
    assert found == {k: 0 if k < 5 else 5 for k in range(15)}
