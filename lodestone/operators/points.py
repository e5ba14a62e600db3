"""Map points from result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import coordinates as C, fixed
from lodestone.operators.position import with_row_position

POINT_SCHEMA = "lon double, lat double, info string"


def extract_points(
    rows: DataFrame,
    order_by: Sequence[str] | None = None,
    keep: Sequence[str] = (),
    position: str | None = None,
    columns: Sequence[str] = fixed.LABEL_COLUMNS,
) -> DataFrame:
    """Valid points with their labels: (keep…, lon, lat, info).

    A row without a label is named by its position among all rows, before any is dropped. The position
    is read from the column `position`, or found from the unique key `order_by`.
    """
    if "lon" not in rows.columns or "lat" not in rows.columns:
        return rows.sparkSession.createDataFrame([], POINT_SCHEMA)
    if position is None and order_by:
        position = "_position"
        rows = with_row_position(rows, order_by, position)
    label = C.label(rows, columns)
    if position is not None:
        label = F.when(label == "", F.concat(F.lit("Запись "), F.col(position).cast("string"))).otherwise(label)
    point = F.struct(
        C.coordinate(rows, "lon", last=False).alias("lon"),
        C.coordinate(rows, "lat", last=True).alias("lat"),
        label.alias("info"),
    )
    # As a generator the cells are parsed once, not for the filter and again for the result.
    valid = F.filter(F.array(point), lambda p: C.in_range(p["lon"], p["lat"]))
    return rows.select(*keep, F.inline(valid))


def point_lines(rows: DataFrame, position: str, keep: Sequence[str] = ()) -> DataFrame:
    """Summary lines `Запись n: Долгота: x, Широта: y`; cells stay text and no range is checked."""
    if "lon" not in rows.columns or "lat" not in rows.columns:
        return rows.sparkSession.createDataFrame([], "position bigint, line string")
    point = F.struct(
        F.col(position).cast("long").alias("position"),
        C.coordinate_text(rows, "lon", last=False).alias("lon"),
        C.coordinate_text(rows, "lat", last=True).alias("lat"),
    )
    whole = F.filter(F.array(point), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    line = F.format_string("Запись %d: Долгота: %s, Широта: %s", "position", "lon", "lat")
    return rows.select(*keep, F.inline(whole)).select(*keep, "position", line.alias("line"))


def marker_text(points: DataFrame, position: str) -> DataFrame:
    """Balloon and hint of each map marker."""
    balloon = F.coalesce(
        F.nullif("info", F.lit("")), F.concat(F.lit("Точка "), F.col(position).cast("string"))
    )
    hint = F.concat(
        F.lit("Долгота: "), F.col("lon").cast("string"), F.lit(", Широта: "), F.col("lat").cast("string")
    )
    return points.withColumns({"balloon": balloon, "hint": hint})


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """Bounding box and point count per key."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
    )


def first_point(points: DataFrame, order: str, *keys: str) -> DataFrame:
    """The point that a map centres on: the first one in `order`."""
    first = F.min_by(F.struct("lon", "lat"), F.col(order))
    return points.groupBy(*keys).agg(first.alias("_first")).select(
        *keys, F.col("_first.lon").alias("centre_lon"), F.col("_first.lat").alias("centre_lat")
    )
