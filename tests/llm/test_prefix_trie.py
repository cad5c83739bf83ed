import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from calathea.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def model(rows):
    """Every node, from plain dictionaries of prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(turns.get(donor, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def found(frame):
    out = P.prefix_trie(frame)
    assert sorted(out.columns) == sorted(COLUMNS)
    return sorted(map(tuple, out.select(COLUMNS).collect()))


def some(seed, n, spread):
    """Conversations of few texts, so that many share first turns; copies, gaps in the ids, hundreds without a donor."""
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        c = rnd.choice([rnd.randrange(250), rnd.randrange(1000, 1100), rnd.randrange(205, 260)])
        if rows and rnd.random() < 0.3:
            again = rnd.choice(rows)[0]
            rows += [(c + 3000, t, r, x) for d, t, r, x in rows if d == again]
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if spread else "user", f"text {rnd.randrange(spread or 1)} ü🙂"))
    return rows


@pytest.mark.parametrize("seed,spread", [(1, 2), (2, 0), (3, 6)])
@pytest.mark.parametrize("turns", [200_000, 40, 1])
def test_against_dictionaries(spark, monkeypatch, seed, spread, turns):
    monkeypatch.setattr(P, "TURNS", turns)
    monkeypatch.setattr(P, "BUCKET", 100)
    rows = some(seed, 120, spread)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == model(rows)


def test_awkward_rows(spark):
    rows = [(0, None, "user", "null first"), (0, 1, None, None), (0, 1, "", ""), (0, 1, "user", "b"), (0, 1, "user", "b"), (0, 0, "user", "zero"), (None, 1, "user", "lost"), (5, 7, "user", "x" * 100_000)]
    rows += [(k, 1, "u", "only") for k in range(700, 720)] + [(-5, 1, "u", "only"), (-105, 2, "u", "n"), (-100, 2, "u", "donor"), (2**62, 1, "u", "far")]
    rows += [(9, t, "u", f"{t}") for t in range(1500)] + [(109, t, "u", f"{t}") for t in range(1500)]
    # a role and a text that only differ in where one ends
    rows += [(20, 1, "ab", "c"), (21, 1, "a", "bc"), (22, 1, "", "abc")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == model(rows)


def test_long_common_beginnings_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(P, "TURNS", 50)
    rows = [(k * 100, t, "u", f"{t if t < 20 else (t, k % 7)}") for k in range(30) for t in range(24 + k % 3)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == model(rows)


def test_ends_in_pieces(spark):
    rows = [(100 * k, 1, "u", "same") for k in range(30_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == model(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_and_more_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []
    assert found(spark.createDataFrame([(3, None, None, None)] * 2, SCHEMA)) == model([(3, None, None, None)] * 2)
    rows = some(4, 30, 2)
    wide = spark.createDataFrame([(*r, "k", None, 5, "n", "d") for r in rows], SCHEMA + ", path string, lens string, k int, sig string, donor string")
    assert found(wide) == model(rows)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from calathea.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    cur = con.execute(ORACLES["op12_prefix_trie"])
    names = [d[0] for d in cur.description]
    got = QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
