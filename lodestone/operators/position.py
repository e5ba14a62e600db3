"""Row position in a total order, without putting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.session import kept

# `monotonically_increasing_id` holds the partition above this bit and the row within it below.
_ROW_BITS = 33


def in_ranges(df: DataFrame, order_by: Sequence[str], purpose: str) -> DataFrame:
    """The rows sorted into ranges and stored, with the number of their range (`_range`) and their own within it (`_row`), so that both stay the same."""
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order_by]
    # Without a number of ranges, Spark joins neighbouring small ones.
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return kept(ordered.withColumn("_id", F.monotonically_increasing_id()), purpose).withColumns(
        {
            "_range": F.shiftright("_id", _ROW_BITS),
            "_row": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_id")


def with_row_position(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in the order of `order_by`, which must be unique per row.

    The rows are sorted into ranges and stored with their number within the range, so that both stay the
    same from then on; the sizes of the ranges before it shift a row to its position.
    """
    placed = in_ranges(df, order_by, "positions")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: a window over them all is small, and so is the broadcast.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_row") + 1
    return placed.join(F.broadcast(before), "_range").withColumn(name, position).drop(
        "_range", "_row", "_before"
    )
