"""Boundaries of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from calathea.functions import scalars as S


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", bytes: "binary", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("name", "size", "want"), [("IMG-123.jpg", 123, "IMG.jpg"), ("IMG-124.jpg", 123, "IMG-124.jpg"), ("IMG.jpg", 1, "IMG.jpg")])
def test_collision_suffix(spark, name, size, want):
    assert one(spark, S.strip_collision(F.col("n"), F.col("s")), n=name, s=size) == want


def test_names(spark):
    assert one(spark, S.extension(F.col("p")), p="a/b.tar.gz") == "GZ"
    assert one(spark, S.extension(F.col("p")), p="a.d/b") == ""
    assert one(spark, S.live_base(F.col("p")), p="IMG_1_HEVC.MOV") == "img_1"
    assert one(spark, S.shared_flag(F.col("p")), p="OD_x.jpg") is False
    assert one(spark, S.shared_flag(F.col("p")), p="od_x.jpg") is True


def test_path_dates(spark):
    assert one(spark, S.path_year(F.col("p")), p="/a/1899/2012/07/x.jpg") == 2012
    assert one(spark, S.path_month(F.col("p")), p="/a/1899/2012/07/x.jpg") == 7
    assert one(spark, S.path_year(F.col("p")), p="/a/b") is None
    assert one(spark, S.path_month(F.col("p")), p="/a/2012/x") is None


@pytest.mark.parametrize(("text", "want"), [("2020:01:02 03:04:05", 1577934245), ("2020:01:02 03:04:05+01:00", 1577930645), ("0000:00:00 00:00:00", None), ("junk", None)])
def test_camera_epoch(spark, text, want):
    assert one(spark, S.camera_epoch(F.col("t")), t=text) == want


@pytest.mark.parametrize(("seconds", "want"), [(59.999, "<1min"), (60.0, "1-5min"), (299.9, "1-5min"), (300.0, "5-20min"), (1200.0, ">20min"), (-1.0, "no-dur")])
def test_duration_bucket(spark, seconds, want):
    assert one(spark, S.duration_bucket(F.col("d")), d=seconds) == want


@pytest.mark.parametrize(("hour", "want"), [(0, "night"), (5, "night"), (6, "morning"), (12, "afternoon"), (17, "afternoon"), (18, "evening")])
def test_time_of_day(spark, hour, want):
    assert one(spark, S.time_of_day(F.col("h")), h=hour) == want


@pytest.mark.parametrize(("a", "b", "want"), [("0" * 16, "f" * 16, 64), ("0" * 16, "0" * 15 + "1", 1), ("f" * 16, "f" * 16, 0), ("x" * 16, "0" * 16, 64), ("8000000000000000", "0" * 16, 1)])
def test_hamming(spark, a, b, want):
    assert one(spark, S.hamming64(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("query", "text", "want"), [("cut", "Cutting", 1000), ("ct", "cut", 999), ("ut", "cut", 996), ("xz", "cut", -1), ("", "cut", 0)])
def test_fuzzy(spark, query, text, want):
    assert one(spark, S.fuzzy_score(query, F.col("t")), t=text) == want


def test_half_even(spark):
    assert one(spark, S.grid_cell(F.lit(2.5), 111320.0)) == 2
    assert one(spark, S.pct(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, S.pct(F.lit(1), F.lit(16))) == 6.2


def test_aspect_and_buckets(spark):
    assert one(spark, S.aspect(F.lit(4000), F.lit(3000), F.lit(6))) == 0.75
    assert one(spark, S.is_portrait(F.lit(4000), F.lit(3000), F.lit(6))) is True
    assert one(spark, S.bucket(F.lit(2020), F.lit(None))) == "2020-00"
    assert one(spark, S.bucket(F.lit(None), F.lit(3))) == "undated"
    assert [one(spark, S.week_of_day(F.lit(d))) for d in (0, 1, 7, 8, 28, 29, 31)] == [9, 0, 0, 1, 3, 4, 4]


def test_arrays_and_boxes(spark):
    assert one(spark, S.repaired_array(F.col("a")), a=["x, y", None, "z", " "]) == ["x", "y", "z"]
    assert one(spark, S.box_area(F.lit('{"x1":1,"y1":1,"x2":3,"y2":4}'))) == 6.0
    assert one(spark, S.box_area(F.lit("no"))) == 0.0
    assert one(spark, S.json_object(F.lit('so: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'
    assert one(spark, S.interval_total(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(2.0)), F.lit(9.0))) == 5.0
    assert one(spark, S.frame_count(F.lit(300))) == 4 and one(spark, S.frame_count(F.lit(301))) == 6
    assert one(spark, S.sample_times(F.lit(4.0), F.lit(2))) == [1.0, 3.0]


def test_text_and_labels(spark):
    assert one(spark, S.canonical_text(F.lit(" A_b,  c! "))) == "a b c"
    assert one(spark, S.human_bytes(F.lit(1536))) == "2KB" and one(spark, S.human_bytes(F.lit(1.5 * 1024**3))) == "1.5GB"
    assert one(spark, S.coordinate_text(F.lit(-1.234), F.lit(5.0))) == "1.23°S 5.00°E"
    assert one(spark, S.place_title(F.lit("Austin"), F.lit("Texas"), F.lit("United States"), {"Texas": "TX"})) == "Austin, TX"
    assert one(spark, S.place_title(F.lit("Bath"), F.lit("Somerset"), F.lit("United Kingdom"), {"Texas": "TX"})) == "Bath, United Kingdom"
    assert one(spark, S.period_key(F.lit(2020), F.lit(3), week=F.lit(1))) == "w:2020-3-1"


def test_files(spark):
    floor = S.least_plausible_bytes(F.lit("mov"), F.lit(10.0), F.lit(None), F.lit(None), 20000)
    assert one(spark, floor) == 200000.0
    cls = lambda size, reads, decodes: one(spark, S.file_class(F.lit(True), F.lit(size), F.lit(100), F.lit(reads), F.lit(decodes)))
    assert [cls(0, True, True), cls(99, True, True), cls(99, False, True), cls(100, True, False), cls(100, True, True)] == ["missing", "truncated", "broken", "corrupt", "unknown"]
    assert one(spark, S.first_filled(F.lit(" "), F.lit(None), F.lit("x"))) == "x"
    assert one(spark, S.number_or_null(F.lit("1e3"))) == 1000.0 and one(spark, S.number_or_null(F.lit("x"))) is None


def test_vectors(spark):
    assert one(spark, S.l2_normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, S.l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.1, abs=0.1)
