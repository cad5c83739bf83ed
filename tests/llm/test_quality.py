from collections import Counter
import re

import numpy as np

from calathea.llm import quality as Q

from .conftest import words


def test_features(docs, corpus):
    got = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.assess(docs).collect())
    want = []
    for i, t, _ in corpus:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = [False] * len(w)
        for k in range(len(w) - 2):
            if count[tuple(w[k : k + 3])] > 1:
                hit[k : k + 3] = [True] * 3
        want.append((repr(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit), len(w) < 50 or 2 * sum(hit) > len(w)))
    assert got == sorted(want)


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good, right = rng.random(40_000) < 0.8, [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(40_000) < 0.3, -1, np.where(rng.random(40_000) < a, good, ~good)) for a in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = Q.expectation_maximisation(patterns, counts)
    assert np.abs(np.array(m.good) - right).max() < 0.03 and np.abs(np.array(m.bad) - right).max() < 0.08 and abs(m.prior - 0.8) < 0.03


def test_em_of_nothing():
    assert Q.expectation_maximisation(np.zeros((0, len(Q.RULES)), int), np.zeros(0, int)).prior == Q.START_PRIOR


def test_junk_goes_and_clean_text_stays(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 900}"[: 4 + k % 5] + "abcdefghij"[k % 10] for k in range(120)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join("ab#$%" if k % 2 else "***" for k in range(100 + i))) for i in range(10)]
    rows = spark.createDataFrame(clean + junk, "doc_id long, text string")
    kept = {r.doc_id for r in Q.keep_good(rows).collect()}
    assert kept == {i for i, _ in clean}


def test_columns_stay(docs, nothing):
    out = Q.keep_good(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert Q.keep_good(nothing).count() == 0 and Q.assess(nothing).count() == 0


def test_one_bad_vote_is_outvoted(spark):
    """Lines that repeat are a bad vote; good votes of rules that tell junk apart outweigh it."""
    word = lambda i, k: f"word{(i * 7 + k) % 900}"[: 4 + k % 3] + "abcdefghij"[k % 10] + "abcdefgh"[(i + k // 10) % 8]
    clean = [(i, "\n".join(" ".join(word(i, k) for k in range(s, s + 20)) for s in range(0, 200, 20))) for i in range(200)]
    lines = [(1000 + i, clean[i][1] + "\nsee below" * 3) for i in range(8)]
    junk = [(2000 + i, " ".join(f"ab{(i + k) % 83}#$%cdefgh" if k % 2 else f"{k}*|{i}" for k in range(150))) for i in range(20)]
    rows = spark.createDataFrame(clean + lines + junk, "doc_id long, text string")
    found = Q.assess(rows)
    voted_bad = [Q.votes("f")[k] == 0 for k in range(len(Q.RULES))]
    named = rows.select("doc_id", Q.text_features("text").alias("f"))
    bad = {r.doc_id for v in voted_bad for r in named.where(v).collect()}
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert {i for i, _ in lines} <= bad and kept == {i for i, _ in clean + lines}


def test_against_a_model_of_its_own(spark, docs):
    """kept and posterior follow from the features by the fitted votes, counted here one document at a time."""
    rows = [r for r in Q.assess(docs).collect()]
    value = {"word_length": lambda r: (r.word_chars, r.n_words), "symbols": lambda r: (r.n_symbols, r.n_words), "alphabetic": lambda r: (r.n_alpha_words, r.n_words), "lines": lambda r: (r.n_dup_lines, r.n_lines), "repeats": lambda r: (r.n_repeat_words, r.n_words), "capitals": lambda r: (r.n_capitals, r.n_letters), "distinct": lambda r: (r.n_distinct_words, r.n_words)}

    def pattern(r):
        out = []
        for name, _, (a, b), (c, d) in Q.RULES:
            top, bottom = value[name](r)
            x = top / bottom if bottom else None
            inside = lambda lo, hi: (lo is None or x >= lo) and (hi is None or x <= hi)  # noqa: E731, B023
            out.append(-1 if x is None else 0 if not inside(a, b) else 1 if inside(c, d) else -1)
        return tuple(out)

    some = Counter(pattern(r) for r in rows if not r.base_failed)
    m = Q.expectation_maximisation(np.array(list(some)), np.array(list(some.values())))
    for r in rows:
        odds = np.log(m.prior / (1 - m.prior))
        for k, v in enumerate(pattern(r)):
            odds += np.log(m.good[k] / (1 - m.bad[k])) if v == 1 else np.log((1 - m.good[k]) / m.bad[k]) if v == 0 else 0
        assert abs(r.posterior - 1 / (1 + np.exp(-odds))) < 1e-6 and r.kept == (not r.base_failed and r.posterior >= Q.THRESHOLD)
