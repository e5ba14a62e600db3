"""Events that come more than once, taken once: the keys of events are state for as long as the watermark allows copies.

A copy that is at most `lateness` younger or older than the first one is dropped; the key leaves the store when the watermark has
passed it by that, so the state is as large as what happens within `lateness`, not as the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def distinct_events(events: DataFrame, keys: list[str], time: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """The first event of each key that arrives, in a stream; in batch any one of each key."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def distinct_stream(
    events: DataFrame, path: str, checkpoint: str, keys: list[str], time: str = "ts", lateness: str = "10 minutes", **trigger
) -> StreamingQuery:
    """Appends each event once to a Parquet table."""
    writer = distinct_events(events, keys, time, lateness).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
