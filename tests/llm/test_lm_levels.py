"""The levels of the trie without Spark: what is stored and with which counts."""


import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from calathea.llm import lm


def built(texts, folder, shards=1):
    """A model of texts in one shard of words, by the functions that the tasks run."""

    def tasks(count, write):
        rows = pa.Table.from_batches(list(count(iter([batch]))))
        shards = sorted(set(rows.column("shard").to_pylist()))
        return [write(rows.filter(pa.array([k == x for x in rows.column("shard").to_pylist()]))).to_pylist()[0] for k in shards]

    batch = pa.record_batch({"text": texts})
    (w,) = tasks(lm._count_words(1), lm._write_words(folder))
    model = lm.Model(folder, np.zeros(1, np.int64), w["tokens"], w["n"], {})
    for level in (2, 3):
        model.shards[level] = shards
        rows = tasks(lm._count_grams(model, level), lm._write_grams(model, level))
        d = lm.discount(sum(r["once"] for r in rows), sum(r["twice"] for r in rows))
        sums = Counter()
        for r in rows:
            sums.update({x["context"]: x["successors"] for x in r["split"]})
        whole = [[{"context": x["context"], "successors": sums[x["context"]]} for x in r["split"]] for r in rows]
        batch2 = pa.record_batch({"shard": [r["shard"] for r in rows], "split": pa.array(whole)})
        list(lm._smooth(model, level, d)(iter([batch2])))
        for k in set(range(shards)) - {r["shard"] for r in rows}:
            nothing = lm.encode(np.zeros(0, np.int64), 1)
            lm.to_file(f"{folder}/level{level}-{k:05d}", {f"{name}.{x}": v for name in ("context", "successor") for x, v in nothing.items()})
            lm.to_file(f"{folder}/smooth{level}-{k:05d}", {name: np.zeros(0, np.uint8) for name in ("probability", "weight")})
    return model


def scores(model, texts):
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts))), "held_out": [True] * len(texts), "text": texts})
    return [x for b in lm._score(model)(iter([rows])) for x in b.column("score").to_pylist()]


def test_counts_that_round_above_a_shard_are_exact(tmp_path, monkeypatch):
    """A pair of 10 tokens rounds to 16, above 11, but is no split context: its successors are scored by its own count."""
    texts = ["a b c"] * 7 + ["a b d"] * 3 + ["x y c", "d c a"]
    whole = scores(built(texts, f"{tmp_path}/whole"), ["a b c", "a b d"])
    monkeypatch.setattr(lm, "SHARD_TOKENS", 11)
    assert scores(built(texts, f"{tmp_path}/small"), ["a b c", "a b d"]) == pytest.approx(whole, abs=1e-9)


def test_pairs_that_occur_once_have_successors(tmp_path):
    """The score of a copy of a training text is that of the whole trigram model, its contexts all of one token."""
    texts = ["one two three four five", "six seven two nine", "two three ten"]
    model = built(texts, f"{tmp_path}/whole")
    train = [[*t.split(), None] for t in texts]
    one, two, three = (Counter(tuple(x[k : k + n]) for x in train for k in range(len(x) - n + 1)) for n in (1, 2, 3))
    n, v = sum(one.values()), len(one)
    d = {}
    for level, c in ((2, two), (3, three)):
        once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
        d[level] = min(lm.MOST_D, max(lm.LEAST_D, once / max(1, once + 2 * twice)))

    def p(gram):
        if len(gram) == 1:
            return (one[gram] + 1) / (n + v + 1)
        table = two if len(gram) == 2 else three
        of = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        return p(gram[1:]) if not of else max(0, table[gram] - d[len(gram)]) / sum(of) + d[len(gram)] * len(of) / sum(of) * p(gram[1:])

    for text in (texts[0], "six seven two three"):
        x = [*text.split(), None]
        want = sum(math.log10(p(tuple(x[max(0, k - 2) : k + 1]))) for k in range(len(x)))
        assert scores(model, [text])[0] == pytest.approx(want, abs=0.03 * len(x))


def test_the_query_stores_them(spark, tmp_path):
    from calathea.llm.queries import QUERIES

    spark.createDataFrame([(0, "p q r s t u")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    (got,) = (r.score for r in QUERIES["op5_lm_scoring"](spark, f"file://{tmp_path}").collect())
    assert got == pytest.approx(scores(built(["p q r s t u"], f"{tmp_path}/trie"), ["p q r s t u"])[0])


def test_split_contexts_weigh_words_of_any_range(tmp_path, monkeypatch):
    """Words that never follow a split context get its backoff weight, whichever shard their range is in."""
    texts = [f"a {w}" for w in "bcd" for _ in range(9)] + [f"{w} z" for w in "efghijklmnopqrstuv"]
    ask = [f"a {w}" for w in "bcefghijklmnopqrstuvz"]
    whole = scores(built(texts, f"{tmp_path}/whole"), ask)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4)
    small = scores(built(texts, f"{tmp_path}/small", shards=7), ask)
    assert small == pytest.approx(whole, abs=1e-9)
