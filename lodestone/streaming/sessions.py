"""Sessions of events: neighbours in time that are less than a gap apart, in batch and as a stream.

A late event may bridge two sessions, which then become one: Spark keeps open sessions as state, merges what overlaps, and gives a session
once the watermark has passed its last event by the gap. Events without a key or a time belong to no session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", measures: list[Column] | None = None, time: str = "ts") -> DataFrame:
    """One row for each session: the keys, `session_start`, `session_end` (last event), `events`, and `measures` (aggregates by name).

    Spark merges sessions within a partition before the shuffle where the measures allow it.
    """
    rows = events.where(F.col(time).isNotNull()).dropna(subset=keys)
    grouped = rows.groupBy(*keys, F.session_window(F.col(time), gap).alias("_session"))
    return grouped.agg(
        F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count(F.lit(1)).alias("events"), *(measures or [])
    )


def session_stream(
    events: DataFrame, path: str, checkpoint: str, keys: list[str], gap: str = "30 minutes", measures: list[Column] | None = None,
    time: str = "ts", lateness: str = "10 minutes", **trigger,
) -> StreamingQuery:
    """Appends each session to a Parquet table when no event can join it any more; events may come `lateness` late."""
    closed = sessions(events.withWatermark(time, lateness), keys, gap, measures, time).drop("_session")
    writer = closed.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
