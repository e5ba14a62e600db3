"""Token usage by period, in batch and as a stream of usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.usage import usage_events

_SUMS = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage_by_period(events: DataFrame, period: str = "1 hour") -> DataFrame:
    """Requests and tokens per model and period. Spark aggregates before the shuffle, in a stream too."""
    recorded = usage_events(events)
    return (
        recorded.groupBy(F.window("ts", period).alias("_w"), "model")
        .agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in _SUMS])
        .select(F.col("_w.start").alias("period_start"), F.col("_w.end").alias("period_end"), "model", "requests", *_SUMS)
    )


def meter_stream(
    events: DataFrame, path: str, checkpoint: str, period: str = "1 hour", lateness: str = "10 minutes", **trigger
):
    """Append each period's usage to a Parquet table once the watermark has passed its end."""
    metered = usage_by_period(events.withWatermark("ts", lateness), period)
    writer = metered.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
