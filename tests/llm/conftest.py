"""Small corpora with the awkward rows that every operator must take."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ", key string, n long, sig string, block int, `surrogate_key` string, quality_features int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): copies, near copies, shared passages, nulls, empty, one-word and very long texts."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, base, rows = some(60), some(150), []
    for _ in range(40):
        rows.append(" ".join(some(rnd.randint(3, 200))))
    for k in range(25):  # near copies, some too far
        w = list(base)
        for _ in range(k % 7):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append("\n".join([" ".join(w[:70]), " ".join(w[70:]).upper() if k % 5 == 0 else " ".join(w[70:])]))
    rows += [rows[3]] * 6 + [rows[41]] * 3
    for k in range(12):  # a passage with little or much around it
        rows.append(" ".join(some(k * 3) + passage + some(k)))
    rows.append(" ".join(some(4000) + passage + passage + some(5)))
    rows += ["", None, " \t\n", "one", "one", "two words", "a b c d", "a b c d", "x" * 5000, "naïve Ünïcode – “quotes” 北京 🙂 é", " nbsp\u0085nel", "A\x0bB\x0cC", "ab\x00cd"]
    out = [(i * 3, t, None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(rows)]
    out += [out[5], out[5]]  # repeated rows
    out.append((out[6][0], "another text under an id that is taken", "s1"))
    out.append((None, rows[2], "s2"))
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, s, "k", 7, "s", 1, "x", 2) for i, t, s in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + CLASHING).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string" + CLASHING)
