"""Comparison of a Spark result with a SQL result as bags of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list:
    """Column mismatch, or the rows that only one side has."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = bag(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return [("columns", sorted(spark_df.columns), sorted(names))]
    found = bag(spark_df.columns, spark_df.collect())
    return [("only spark", r) for r in (found - expected)][:3] + [("only sql", r) for r in (expected - found)][:3]
