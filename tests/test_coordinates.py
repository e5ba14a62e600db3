import pytest
from pyspark.sql import functions as F

from lodestone.functions import coordinates as C
from lodestone.operators.points import bounds, extract_points, first_point, marker_text, point_lines
from lodestone.operators.position import with_row_position

CELLS = {
    "50.1": (50.1, 50.1),
    " 50.1 ": (50.1, 50.1),
    "[50.1, 40.2]": (50.1, 40.2),
    "[50.1]": (50.1, 50.1),
    "[1,2,3]": (1.0, 3.0),
    "[50.1, 40.2": (50.1, 40.2),
    "['50.1','40.2']": (50.1, 40.2),
    '["50.1", "40.2"]': (50.1, 40.2),
    "['50,1', '40,2']": (None, None),
    "['50,1', 40.2]": (None, 40.2),
    '["1" , "2", ]': (1.0, 2.0),
    "[5,]": (5.0, 5.0),
    "[5,": (5.0, None),
    "[,5]": (None, 5.0),
    "[]": (None, None),
    "": (None, None),
    "x": (None, None),
    "50,1": (None, None),
    "['5": (None, None),
    "[[1, 2], [3, 4]]": (1.0, 4.0),
    "1_0": (None, None),
    "nan": (None, None),
    "inf": (None, None),
    "1d": (None, None),
    "+.5e1": (5.0, 5.0),
    "-7.": (-7.0, -7.0),
}


@pytest.mark.parametrize("last", [False, True])
def test_cells(evaluate, last):
    found = evaluate(C.cell_number(F.col("c"), last), [*CELLS, None])
    assert dict(zip(CELLS, found)) == {cell: pair[last] for cell, pair in CELLS.items()}
    assert found[-1] is None


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "180", "90", "L", None),
        (2, "180.5", "10", "L", None),
        (3, "10", "90.5", "L", None),
        (4, "10", "20", None, None),
        (5, None, "20", "L", None),
        (6, "[10, 20]", "[10, 20]", "L", "R"),
    ]
    return spark.createDataFrame(rows, "key int, lon string, lat string, layer_name string, `Регион` string")


def test_points(records):
    points = extract_points(records, order_by=["key"], keep=["key"]).orderBy("key").collect()
    assert [tuple(p) for p in points] == [
        (1, 180.0, 90.0, "layer_name: L"),
        (4, 10.0, 20.0, "Запись 4"),
        (6, 10.0, 20.0, "layer_name: L, Регион: R"),
    ]


def test_no_coordinate_columns(records):
    assert extract_points(records.drop("lon")).collect() == []


def test_summary_lines_check_no_range(records):
    lines = [r["line"] for r in point_lines(records, "key").orderBy("position").collect()]
    assert lines[1] == "Запись 2: Долгота: 180.5, Широта: 10"
    assert len(lines) == 5


def test_bounds_and_markers(records):
    points = extract_points(records, keep=["key"])
    box = bounds(points).head()
    assert (box["points"], box["min_lon"], box["max_lon"]) == (3, 10.0, 180.0)
    assert tuple(first_point(points, "key").head()) == (180.0, 90.0)
    markers = marker_text(points, "key").orderBy("key").collect()
    assert markers[1]["balloon"] == "Точка 4"
    assert markers[0]["hint"] == "Долгота: 180.0, Широта: 90.0"


@pytest.mark.parametrize("keys", [["a"], ["b", "a"]])
def test_position(spark, keys):
    rows = [(i, "hot" if i % 3 == 0 else f"v{i % 50}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    found = {r["a"]: r["position"] for r in with_row_position(df, keys).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]) if keys[0] == "b" else r[0])
    assert found == {row[0]: i + 1 for i, row in enumerate(order)}
