"""What streams leave behind: tables whose batches replace themselves, and stores that stateful operators need."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep several states and timers a key, which takes Spark's store on disk."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class BatchTable:
    """A Parquet table with a folder for each micro-batch.

    A batch that is run again, after a restart in its middle, replaces its folder, so the table holds each batch once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, schema: str) -> DataFrame:
        """All rows with the number of their batch; none if no batch was written yet."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(self.path)

    def latest(self, schema: str, key: str, order: str | None = None) -> DataFrame:
        """The last row of each key."""
        rows = self.read(schema)
        columns = [c for c in rows.columns if c not in (key, "batch")]
        place = F.struct("batch", *([order] if order else []))
        found = rows.groupBy(key).agg(F.max_by(F.struct(*columns), place).alias("_row"))
        return found.select(key, "_row.*")
