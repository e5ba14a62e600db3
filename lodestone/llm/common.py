"""What several operators share: row keys, whole texts as bytes, stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import discard, expire, read_table, shared_dir, shuffles_cleaned

#: What stands for a null `doc_id` in keys; it orders before every other.
NO_ID = -(1 << 63)


class Stored:
    """A table in the shared folder that outlives executors; `drop()` it when nothing reads it, else it goes with the application."""

    def __init__(self, df: DataFrame, purpose: str):
        self.spark, self.path = df.sparkSession, shared_dir(df.sparkSession, purpose)
        with shuffles_cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        expire(self.spark, self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        discard(self.spark, self.path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_bytes(column: Column | str = "text") -> Column:
    """The whole text as UTF-8; null is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def keyed(docs: DataFrame) -> DataFrame:
    """`did`, `rk` and `body`: a row's key is its id and a hash of its text, so it needs no numbering of rows.

    Rows of the same id and text share a key; a null id is `NO_ID` with a key of its own by text.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))).alias("rk"),
        text_bytes().alias("body"),
    )


def public_id(column: str = "did") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def learnable(column: Column | str = "doc_id") -> Column:
    """Labels may be learnt from these rows; the others are held out."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % 4 != 2
