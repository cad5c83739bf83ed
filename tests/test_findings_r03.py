"""What the third round's findings were about."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from calathea.operators import circles, matching, neighbours, vectors, windows
from calathea.queries import ORACLES, QUERIES

FILE = "stem string, ext string, size int, at int, duration double"


def test_elsewhere_against_all_pairs(spark):
    def of(n, step):
        return [(k, None if k % 13 == 0 else f"s{k % 7}", "mov" if k % 2 else "mp4", None if k % 11 == 0 else k * step % 5, None if k % 17 == 0 else k % 4, None if k % 3 == 0 else k * step % 19 / 4) for k in range(n)]

    records, assets = of(150, 1) + [(900, "none", "mov", 77, 77, None)], of(40, 3) + [(901, "own", "mov", 99, 99, 1.0)] + [(k, f"t{k}", "mov", k, k, k % 9 / 3) for k in range(910, 930)]
    records += [(k, f"t{k}" if k % 2 else "x", "mov", k if k % 3 else 1, k, 0.5) for k in range(910, 930)]
    got = {r.record: (r.asset, r.status, r.candidates) for r in matching.elsewhere(spark.createDataFrame(records, "record int, " + FILE), spark.createDataFrame(assets, "asset int, " + FILE)).collect()}
    eq = lambda a, b: a is not None and a == b
    assert len(got) == len(records)
    for k, stem, ext, size, at, length in records:
        found = [x for x in assets if (eq(stem, x[1]) and ext == x[2]) or (eq(size, x[3]) and eq(at, x[4]))]
        same = [x[0] for x in found if eq(size, x[3])]
        full = [x[0] for x in found if eq(size, x[3]) and eq(at, x[4]) and (length is None or (x[5] is not None and abs(length - x[5]) < 1))]
        asset = same[0] if len(same) == 1 else full[0] if len(full) == 1 else found[0][0] if len(found) == 1 else None
        status = "NO_MATCH" if not found else "OK" if len(same) == 1 or len(full) == 1 else "SIZE_MISMATCH" if len(found) == 1 and not same else "AMBIGUOUS"
        assert got[k] == (asset, status, len(found)), k
    assert {s for _, s, _ in got.values()} == {"NO_MATCH", "OK", "SIZE_MISMATCH", "AMBIGUOUS"}


def test_elsewhere_makes_no_pairs_of_a_common_name(spark):
    row = [F.lit("a").alias("stem"), F.lit("mov").alias("ext"), (F.col("id") % 9).cast("int").alias("size"), (F.col("id") % 2).cast("int").alias("at"), F.lit(1.0).alias("duration")]
    many = spark.range(50_000)  # 2.5 billion pairs
    found = matching.elsewhere(many.select(F.col("id").alias("record"), *row), many.select(F.col("id").alias("asset"), *row))
    assert [tuple(r) for r in found.groupBy("status", "candidates").count().collect()] == [("AMBIGUOUS", 50_000, 50_000)]


def test_recent_rate_in_a_crowded_time(spark):
    rows = spark.range(400_000).select("id", F.lit("g").alias("g"), (F.col("id") / 1_000).cast("long").alias("at"))  # all within the seconds
    found = windows.recent_rate(rows, ["g"], "at", "id", 36_000, 20)
    want = F.when((F.col("id") >= 1_000) & (F.col("id") % 1_000 < 19), 19 * 60.0)
    assert found.where(~F.col("rate").eqNullSafe(want)).count() == 0 and found.count() == 400_000


def same_as_sql(spark, tmp_path, name, **tables):
    """A query's rows on these tables (SQL for each), which are those of its own SQL."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet'")
        con.execute(f"create view {table} as from '{tmp_path}/{table}.parquet'")
    found = con.execute(f"select columns(*) from ({ORACLES[name]})")
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=repr)
    assert got == want
    return [dict(zip(columns, r, strict=True)) for r in got]


#: Times with all fractions of a second, many in the last half second of a minute.
TIMES = "SELECT i AS event_id, TIMESTAMP '2024-01-05 00:00:57.25' + to_microseconds(i // 40 * 60000000 + i * 250000 % 4000000) AS ts, i % 3 AS user_id, CASE WHEN i % 2 = 0 THEN 'click' ELSE 'signup' END AS event_type, i::DOUBLE AS value FROM range(400) AS r(i)"


def test_sized_match_by_rounded_seconds(spark, tmp_path):
    assert len(same_as_sql(spark, tmp_path, "sized_match", events=TIMES)) > 100


def test_match_methods_by_rounded_seconds(spark, tmp_path):
    """A click and its name's record almost three minutes later: with that one's second rounded up, two minutes are three."""
    late = "SELECT 1 AS event_id, TIMESTAMP '2024-01-05 12:00:10' AS ts, 1 AS user_id, 'click' AS event_type UNION ALL SELECT 2, TIMESTAMP '2024-01-05 12:02:59.75', 1, 'signup'"
    assert [r["tier"] for r in same_as_sql(spark, tmp_path, "match_methods", events=late)] == ["date_tz"]


def test_match_methods_without_ids_and_before_1970(spark, tmp_path):
    """Clicks and records without ids, and minutes that are cut towards zero, as an integer division cuts them."""
    rows = TIMES.replace("i % 3 AS user_id", "i * 31 % 400 AS user_id")
    same_as_sql(spark, tmp_path, "match_methods", events=f"SELECT * REPLACE (CASE WHEN event_id // 2 % 9 > 0 THEN event_id END AS event_id) FROM ({rows})")
    rows = f"SELECT * REPLACE (TIMESTAMP '1969-12-31 23:50:57.25' + to_microseconds(event_id * 7100000) AS ts) FROM ({rows})"
    assert len(same_as_sql(spark, tmp_path, "sized_match", events=rows)) > 100


def test_stage_rates_beyond_the_total(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "stage_rates", events="SELECT TIMESTAMP '2024-01-29 12:00:00' AS ts, CASE WHEN i < 25000 THEN 'a' ELSE 'b' END AS event_type FROM range(26000) AS r(i)")
    assert sorted(r["eta_s"] < 0 for r in rows) == [False, True]


def test_sketch_months_larger_than_a_sketch(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "sketch_months", events="""SELECT TIMESTAMP '2024-01-01' + to_hours(i % 1400) AS ts, i * 7919 % 9001 AS user_id, CASE WHEN i % 20 = 0 THEN 'few' WHEN i % 23 > 0 THEN 'many' END AS event_type,
      CASE WHEN i % 7 > 0 THEN i * 104729 % 50021 / 4.0 END AS value FROM range(40000) AS r(i)""")
    assert {r["event_type"] for r in rows} == {"few", "many", None} and max(r["distinct"] for r in rows) > 4_096


def test_heroes_of_large_ids(spark, tmp_path):
    """Among views, the SQL's measure falls with the id: beyond 100,000, by more than a step of sharpness."""
    rows = same_as_sql(spark, tmp_path, "heroes", events="SELECT i * 100003 AS event_id, i % 5 AS user_id, CASE WHEN i % 5 = 0 AND i > 50 THEN 'click' ELSE 'view' END AS event_type, i::DOUBLE AS value FROM range(200) AS r(i)")
    assert len(rows) == 5


def test_copies_of_rows_are_sent_in_bounded_batches():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    tables = [neighbours.planes(x.astype(float), 700, 16, seed) for seed in range(4)]
    rows = pa.record_batch({"cid": pa.array(np.arange(700)), "vec": pa.array(list(x), pa.list_(pa.float32()))})
    sent = list(neighbours._dealt(tables, 20, {}, True, True)(iter([rows])))
    assert sum(b.num_rows for b in sent) > 700 * 4 * 20 - 1 and max(b.num_rows for b in sent) <= 8_192


def test_rows_that_ask_a_bucket_pass_by_it_in_batches():
    """One part of a bucket, over many batches: no table of it is made, and each row meets all that lie there."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)

    def of(place, ids, lies):
        n = len(ids)
        return pa.record_batch([pa.array([place] * n, pa.int32()), pa.array([place] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([lies] * n), pa.array([True] * n), pa.array(ids), pa.array(list(x[ids]), pa.list_(pa.float32()))], names=["table", "bucket", "part", "lies", "asks", "cid", "vec"])

    lie, ask = np.arange(30), np.arange(30, 400)
    batches = [of(0, lie[:20], True), of(0, lie[20:], True), *(of(0, ask[s : s + 50], False) for s in range(0, 370, 50)), of(1, ask, False), of(2, lie, True)]
    hits = [r for b in neighbours._met(3, -np.inf)(iter(batches)) for r in b.to_pylist()]
    exact = x.astype(float) @ x[:30].astype(float).T
    want = {(q, int(i)) for q in range(400) for i in np.argsort(-exact[q])[:3]}
    assert {(r["query"], r["id"]) for r in hits} == want and len(hits) == 3 * 430


def test_candidate_status_by_counts_alone(spark):
    rows = [(1, 10, 3), (1, 11, 3), (1, 12, 2), (2, 20, 5), (2, 21, 4), (3, 30, None), (4, 40, 1), (4, 41, None), (1, 11, 3)]
    frame = spark.createDataFrame(rows, "k int, s int, c int")
    for repeated in (True, False):
        found = matching.candidate_status(frame if repeated else frame.distinct(), "k", "s", F.col("c"), repeated)
        assert sorted(map(tuple, found.collect())) == [(1, 10, 3, "ambiguous"), (2, 20, 5, "matched"), (4, 40, 1, "matched")]
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_pairs_are_multiplied_in_slices():
    """Two blocks of 4,096 rows: their whole product alone is 134 MB."""
    import tracemalloc

    x = np.random.default_rng(7).normal(size=(8_192, 4)).astype(np.float32)
    table = pa.table({"id": pa.array(np.arange(8_192)), "vec": pa.array(list(x), pa.list_(pa.float32())), "side": pa.array([0] * 4_096 + [1] * 4_096), "i": pa.array([0] * 8_192), "j": pa.array([1] * 8_192)})
    tracemalloc.start()
    found = vectors._pairs(5, 0.3)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows >= 4_096 * 4 and peak < 40_000_000


def test_cells_that_a_circle_holds_whole(spark):
    """Places all over such cells are within the circle, poles and the 180th meridian included; most of its area is in them."""
    rng = np.random.default_rng(11)
    rows = [(i, float(lat), float(lon), float(km)) for i, (lat, lon, km) in enumerate(zip([*rng.uniform(-90, 90, 60), 90.0, -89.9, 0.0], [*rng.uniform(-180, 180, 60), 10.0, 179.9, 180.0], [*(10 ** rng.uniform(0, 4.2, 60)), 900.0, 50.0, 300.0], strict=True))]
    cover = circles.cells_of_circles(spark.createDataFrame(rows, "p int, lat double, lon double, km double"), "lat", "lon", "km", circles.FINER)
    level, found = F.col("level"), cover.withColumn("whole", circles._holds_cell("lat", "lon", "km"))
    high, wide = circles._width(level), 360 / circles._around(level, F.col("band"))
    spots = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0.0, 0.3, 1.0) for b in (0.0, 0.6, 1.0))))
    at = found.where("whole").withColumn("s", spots).select("lat", "lon", "km", (F.lit(-90.0) + (F.col("band") + F.col("s.a")) * high).alias("y"), ((F.col("cell") + F.col("s.b")) * wide - 180).alias("x"))
    assert at.where(circles.S.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) > F.col("km")).count() == 0
    whole, every = found.where("whole").count(), found.count()
    assert 0.15 < whole / every and every < 200 * len(rows)


def test_at_home_among_dense_circles(spark):
    """Against all pairs, with circles that end, that never end, that end before they start, and without a start."""
    rng = np.random.default_rng(13)
    month = lambda n: f"{2000 + n // 12}-{n % 12 + 1:02d}"
    homes = [(None if i % 31 == 0 else month(i % 40), None if i % 4 == 0 else month(i % 40 + i % 9 - 2 if i % 40 else 5), float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), float(10 ** rng.uniform(0, 3.6)), [f"t{i}"]) for i in range(400)]
    points = [(i, None if i % 50 == 0 else float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), None if i % 77 == 0 else month(i % 45), f"t{i * 7}" if i % 9 == 0 else None) for i in range(3_000)]
    found = circles.at_home(spark.createDataFrame(points, "k int, lat double, lon double, ym string, title string"), spark.createDataFrame(homes, "start string, end string, lat double, lon double, radius_km double, areas array<string>"))
    got = {r.k: r.home for r in found.collect()}

    def near(a, b, c, d, km):
        a, b, c, d = np.radians([a, b, c, d])
        return 2 * 6371.0088 * np.arcsin(min(1.0, np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))) <= km

    want = {k: ym is not None and any(s is not None and s <= ym and (e is None or ym <= e) and (title in areas or (lat is not None and near(lat, lon, y, x, km))) for s, e, y, x, km, areas in homes) for k, lat, lon, ym, title in points}
    assert got == want and 300 < sum(want.values()) < 2_700


def test_dense_circles_are_not_compared_one_by_one(spark, monkeypatch):
    """Points well within a crowd of circles, in its months and before them: no distance is asked for."""
    homes = spark.range(4_000).select(F.lit("2001-01").alias("start"), F.lit(None).cast("string").alias("end"), (F.col("id") % 61 / 100).alias("lat"), (F.col("id") % 67 / 100).alias("lon"), F.lit(500.0).alias("radius_km"), F.array(F.lit("a")).alias("areas"))
    points = spark.range(40_000).select("id", (F.col("id") % 211 / 300).alias("lat"), (F.col("id") % 199 / 300).alias("lon"), F.when(F.col("id") % 2 == 0, "2000-06").otherwise("2002-01").alias("ym"), F.lit("b").alias("title"))
    monkeypatch.setattr(circles, "_holds", lambda *at: F.raise_error(F.concat_ws(" ", "__lat", *at)).isNull())
    assert circles.at_home(points, homes).where("home").count() == 20_000


def test_rows_that_only_ask_are_sent_in_bounded_batches():
    """As `search` deals its queries: copies in bounded batches, none of which lies in a bucket."""
    x = np.random.default_rng(17).normal(size=(600, 16)).astype(np.float32)
    tables = [neighbours.planes(x.astype(float), 600, 16, seed) for seed in range(3)]
    rows = pa.record_batch({"cid": pa.array(np.arange(600)), "vec": pa.array(list(x), pa.list_(pa.float32()))})
    sent = list(neighbours._dealt(tables, 20, {(0, 0): 3}, False, True)(iter([rows])))
    assert sum(b.num_rows for b in sent) > 600 * 3 * 20 - 1 and max(b.num_rows for b in sent) <= 8_192
    assert not any(b.column(3).true_count for b in sent)


def test_two_blocks_meet_in_one_task(spark):
    """Equal to all pairs with ties, equal ids, large and tiny vectors; a row is sent once for each block."""
    rng = np.random.default_rng(19)
    x = rng.normal(size=(900, 8))
    x[300:600] = x[:300] + rng.normal(size=(300, 8)) * 1e-9  # near ties, beyond single precision
    x[600:640], x[640:680] = x[:40], x[640:680] * 1e-6
    ids = np.r_[np.arange(899), 7]
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    for scale in (1.0, 1e20):
        scaled = frame.withColumn("v", F.transform("v", lambda y: y * scale))
        y, got = x * scale, {}
        for r in vectors.neighbour_edges(scaled, "id", "v", 5, 0.3 * scale * scale, block=128).collect():
            got.setdefault(r.query, []).append((-r.score, r.id))
        want = {}
        for i in range(900):
            hits = sorted((-float(s), int(ids[o])) for o, s in enumerate((y * y[i]).sum(axis=1)) if ids[o] != ids[i] and s >= 0.3 * scale * scale)
            want[int(ids[i])] = sorted(want.get(int(ids[i]), []) + hits[:60])
        want = {q: h[:5] for q, h in want.items() if h}
        assert {q: sorted(h) for q, h in got.items()} == want
    blocks = [r for r in vectors._pairs(5, 0.3)(pa.table({"id": pa.array(np.arange(200)), "vec": pa.array(list(x[:200])), "side": pa.array([0] * 90 + [1] * 110), "i": pa.array([0] * 200), "j": pa.array([1] * 200)})).to_pylist()]
    assert {r["query"] < 90 for r in blocks} == {True, False} and all((r["query"] < 90) != (r["id"] < 90) for r in blocks)
