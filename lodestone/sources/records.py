"""Record tables: reading, listing and previewing."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def infer_schema(spark: SparkSession, path: str, out: str | None = None) -> T.StructType:
    """Schema of JSON lines from all of their rows; `out` keeps it as text, so that it is found once."""
    schema = spark.read.option("samplingRatio", 1.0).json(path).schema
    if out:
        spark.createDataFrame([(schema.json(),)], "value string").write.mode("overwrite").text(out)
    return schema


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(path, wholetext=True).head()[0]))


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Record table from JSON lines; its columns are all the keys that occur, plus `_id`.

    A folder without files is an empty table.
    """
    try:
        schema = schema or infer_schema(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        schema = T.StructType()
    if not any(f.name == "_id" for f in schema):
        schema = T.StructType([*schema.fields, T.StructField("_id", T.StringType())])
    return spark.read.schema(schema).json(path)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views by name with their row counts; a table that cannot be resolved has none, and an error class instead.

    All tables are counted by one plan, a branch for each.
    """
    parts = [spark.createDataFrame([], "name string, rows bigint, error string")]
    for table in sorted(spark.catalog.listTables(), key=lambda t: t.name):
        try:
            rows = spark.table(f"`{table.name}`").agg(F.count(F.lit(1)).alias("rows"))
            parts.append(rows.select(F.lit(table.name).alias("name"), "rows", F.lit(None).cast("string").alias("error")))
        except AnalysisException as error:
            missing = [(table.name, None, error.getCondition())]
            parts.append(spark.createDataFrame(missing, "name string, rows bigint, error string"))
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, n: int, *order_by: Column) -> DataFrame:
    """The first n rows in an order, as JSON, next to the true row count."""
    shown = df.orderBy(*order_by).limit(n).select(F.to_json(F.struct("*")).alias("document"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return shown.withColumn("total", total.scalar())


def metadata(df: DataFrame, *without: str) -> Column:
    """All other fields of a row as one JSON text."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]))
