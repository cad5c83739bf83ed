"""Every query with a DuckDB oracle against it, at the smallest scale; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from calathea.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


#: Columns of the queries without SQL, which are tested against plain models elsewhere.
COLUMNS = {
    "greedy_diverse": None, "greedy_merge": None, "unique_one_to_one": ["a", "b", "cost"], "knn_edges_lsh": ["query", "id", "score", "rank"], "knn_topk_lsh": ["query", "id", "score", "rank"],
    "huber_head": ["name", "value"], "map_clusters": ["zoom", "id", "n", "lat", "lon", "parent"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    found = QUERIES[name](spark, SF)
    assert name in COLUMNS and (COLUMNS[name] is None or found.columns == COLUMNS[name])
    rows = found.collect()
    assert rows and len(set(map(repr, rows))) == len(rows)
    key = {"knn_edges_lsh": ("query", "rank"), "knn_topk_lsh": ("query", "rank"), "map_clusters": ("zoom", "id"), "unique_one_to_one": ("a",), "huber_head": ("name",)}.get(name)
    assert key is None or len({tuple(r[c] for c in key) for r in rows}) == len(rows)
