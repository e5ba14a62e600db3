"""Joins on ranges, and columns of mixed types."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators.combine import mixed_value, tagged_union
from lodestone.operators.range_join import interval_join, overlap_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def numbers():
    rng = random.Random(6)
    points = [(i, rng.choice([rng.uniform(-50, 50), rng.randrange(-8, 8) / 4, None, 0.0, float("nan")]), i % 3) for i in range(200)]
    spans = []
    for i in range(150):
        low = rng.choice([rng.uniform(-60, 60), rng.randrange(-8, 8) / 4, None])
        # Lengths of every size, whole powers of two, none, and ends before starts.
        length = rng.choice([0.0, 0.25, 1.0, 1e-9, 1e9, rng.uniform(0, 20), -1.0])
        spans.append((i, low, None if low is None else low + length, i % 3))
    return points, spans


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("on", [(), ("k",)])
def test_every_point_finds_its_intervals(spark, closed, on):
    points, spans = numbers()
    p = spark.createDataFrame(points, "p int, x double, k int")
    s = spark.createDataFrame(spans, "s int, a double, b double, k int")
    if not on:
        p, s = p.drop("k"), s.drop("k")
    found = interval_join(p, s, "x", "a", "b", on, closed)
    expected = sorted(
        (i, j) for i, x, k in points for j, a, b, m in spans
        if x is not None and x == x and a is not None and a <= x and (x <= b if closed else x < b) and (not on or k == m)
    )
    assert sorted((r.p, r.s) for r in found.collect()) == expected
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


@pytest.mark.parametrize("kind", ["long", "date", "timestamp", "timestamp_ntz"])
def test_ranges_of_other_types(spark, kind):
    rng = random.Random(8)
    start = {"long": 1 << 61, "date": date(1969, 12, 1)}.get(kind, datetime(1969, 12, 31, 23, 59, 58))
    step = {"long": lambda n: n, "date": lambda n: timedelta(days=n)}.get(kind, lambda n: timedelta(microseconds=n * 1_700_003))
    points = [(i, start + step(rng.randrange(60))) for i in range(60)]
    spans = [(i, start + step(a), start + step(a + rng.randrange(30))) for i in range(40) for a in [rng.randrange(60)]]
    found = interval_join(spark.createDataFrame(points, f"p int, x {kind}"), spark.createDataFrame(spans, f"s int, a {kind}, b {kind}"), "x", "a", "b")
    assert sorted((r.p, r.s) for r in found.collect()) == sorted((i, j) for i, x in points for j, a, b in spans if a <= x < b)


def test_overlaps_are_found_once(spark):
    rng = random.Random(9)
    left, right = ([(i, a, a + rng.choice([0, 1, 3, 500])) for i in range(60) for a in [rng.randrange(40)]] for _ in range(2))
    found = overlap_join(spark.createDataFrame(left, "l int, a int, b int"), spark.createDataFrame(right, "r int, c int, d int"), ("a", "b"), ("c", "d"))
    assert sorted((r.l, r.r) for r in found.collect()) == sorted((i, j) for i, a, b in left for j, c, d in right if a < d and c < b and a < b and c < d)


def test_empty_sides_and_names_of_both(spark):
    p = spark.createDataFrame([(1, 1.0)], "p int, x double")
    s = spark.createDataFrame([], "s int, a double, b double")
    assert interval_join(p, s, "x", "a", "b").collect() == []
    assert interval_join(p.limit(0), spark.createDataFrame([(1, 0.0, 2.0)], "s int, a double, b double"), "x", "a", "b").collect() == []
    with pytest.raises(ValueError, match="both sides"):
        interval_join(p, s.withColumnRenamed("s", "p"), "x", "a", "b")
    with pytest.raises(ValueError, match="no range of string"):
        interval_join(p.withColumn("x", F.lit("1")), s, "x", "a", "b")


def test_mixed_columns_keep_their_values(spark):
    branches = {
        "whole": spark.sql("SELECT 1 AS v"), "text": spark.sql("SELECT '5' AS v"), "list": spark.sql("SELECT array(1, 2) AS v"),
        "truth": spark.sql("SELECT true AS v"), "object": spark.sql("SELECT named_struct('a', 1.5D) AS v"), "none": spark.sql("SELECT CAST(NULL AS int) AS v"),
        "day": spark.sql("SELECT DATE'2024-01-02' AS v"),
    }
    found = tagged_union(branches, variant=True).select("matched_feature", mixed_value("v").alias("m")).select("matched_feature", "m.*")
    rows = {r.matched_feature: tuple(r)[1:] for r in found.collect()}
    assert rows["whole"] == ("BIGINT", 1.0, None, None, None) and rows["text"] == ("STRING", None, None, "5", None)
    assert rows["list"] == ("ARRAY<BIGINT>", None, None, None, "[1,2]") and rows["truth"] == ("BOOLEAN", None, True, None, None)
    assert rows["object"] == ("OBJECT<a: DOUBLE>", None, None, None, '{"a":1.5}')
    assert rows["none"][1:] == (None, None, None, None) and rows["day"] == ("DATE", None, None, "2024-01-02", None)
    # A column whose branches agree is of their type.
    same = tagged_union({"a": spark.sql("SELECT 1 AS v"), "b": spark.sql("SELECT 2.5D AS v")}, variant=True)
    assert same.schema["v"].dataType.simpleString() == "double"


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("on", [(), ("k",)])
def test_totals_are_those_of_the_pairs_without_making_them(spark, closed, on):
    points, spans = numbers()
    points = [(None if i % 7 == 0 else i, x, None if i % 11 == 0 else k) for i, x, k in points] + [(1 << 62, 0.0, 0), (1 << 62, -0.0, 0), (1 << 62, 40.0, 1)]
    # An interval that comes twice is there twice, and one holds everything.
    spans += [spans[1], (500, -1e9, 1e9, 1), (501, -0.0, 0.25, 0)]
    p = spark.createDataFrame(points, "p long, x double, k int")
    s = spark.createDataFrame(spans, "s int, a double, b double, k int")
    if not on:
        p, s = p.drop("k"), s.drop("k")
    found = interval_join(p, s, "x", "a", "b", on, closed, totals={"many": None, "ids": "p"}).where("s <> 500")
    expected = []
    for j, a, b, m in spans:
        hits = [i for i, x, k in points if x is not None and x == x and a is not None and a <= x and (x <= b if closed else x < b) and (not on or k == m)]
        if hits and j != 500:
            ids = [i for i in hits if i is not None]
            expected.append((j, len(hits), sum(ids) if ids else None))
    small = [(j, n, i) for j, n, i in expected if i is None or i < 1 << 63]
    assert sorted((r.s, r.many, r.ids) for r in found.where(F.col("s").isin([j for j, _, _ in small])).collect()) == sorted(small)
    assert "_bin" not in plan(found)


def test_totals_of_empty_sides(spark):
    p, s = spark.createDataFrame([(1, 1.0)], "p int, x double"), spark.createDataFrame([(1, 0.0, 2.0)], "s int, a double, b double")
    for points, spans in ((p.limit(0), s), (p, s.limit(0))):
        assert interval_join(points, spans, "x", "a", "b", totals={"n": None}).collect() == []
    assert [tuple(r) for r in interval_join(p, s, "x", "a", "b", totals={"n": None, "t": "p"}).collect()] == [(1, 0.0, 2.0, 1, 1)]
    with pytest.raises(ValueError, match="whole numbers"):
        interval_join(p, s, "x", "a", "b", totals={"t": "x"})
