"""Comparison of two loads, and the rest of an interrupted one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def key_differences(expected: DataFrame, stored: DataFrame, key: str = "_id") -> DataFrame:
    """Keys whose number of rows differs: (key, expected, stored).

    Both sides are counted by one aggregation over their union. It has a partial step before its
    shuffle, so many copies of a key do not meet in one task.
    """
    sides = expected.select(F.col(key), F.lit(1).alias("_e"), F.lit(0).alias("_s")).unionByName(
        stored.select(F.col(key), F.lit(0).alias("_e"), F.lit(1).alias("_s"))
    )
    counted = sides.groupBy(key).agg(F.sum("_e").alias("expected"), F.sum("_s").alias("stored"))
    return counted.where(F.col("expected") != F.col("stored"))


def load_summary(expected: DataFrame, stored: DataFrame, key: str = "_id") -> DataFrame:
    """Row counts of both sides, missing and surplus rows, and whether the load is whole."""
    sides = expected.select(F.col(key), F.lit(1).alias("_e"), F.lit(0).alias("_s")).unionByName(
        stored.select(F.col(key), F.lit(0).alias("_e"), F.lit(1).alias("_s"))
    )
    counted = sides.groupBy(key).agg(F.sum("_e").alias("e"), F.sum("_s").alias("s"))
    zero = F.lit(0).cast("long")

    def total(column) -> F.Column:
        return F.coalesce(F.sum(column), zero)

    return counted.agg(
        total(F.col("e")).alias("expected_rows"),
        total(F.col("s")).alias("stored_rows"),
        total(F.greatest(F.col("e") - F.col("s"), zero)).alias("missing_rows"),
        total(F.greatest(F.col("s") - F.col("e"), zero)).alias("surplus_rows"),
    ).withColumns(
        {
            "complete": (F.col("missing_rows") == 0) & (F.col("surplus_rows") == 0),
            "critical": (F.col("stored_rows") == 0) & (F.col("expected_rows") > 0),
        }
    )


def remaining(items: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that no finished row names. Spark broadcasts the finished keys only if they are small."""
    return items.join(finished.select(*keys).distinct(), list(keys), "left_anti")
