"""Token usage and its cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions import fixed
from lodestone.functions.text import spaced_number

_COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")


def price_table(spark: SparkSession, prices: Mapping[str, float] = fixed.MODEL_PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices.items()), "model string, price_per_1k double")


def usage_events(responses: DataFrame) -> DataFrame:
    """Usage of each response; one without any token is not recorded.

    A missing or zero total is the sum of its parts.
    """
    prompt, completion = (F.coalesce(c, F.lit(0)).cast("long") for c in _COUNTS[:2])
    total = F.coalesce(F.nullif(F.col("total_tokens").cast("long"), F.lit(0).cast("long")), prompt + completion)
    recorded = F.greatest(*[F.coalesce(c, F.lit(0)) for c in _COUNTS]) > 0
    return responses.where(recorded).withColumns(
        {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": total}
    )


def in_period(events: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Events of a period. A reset is a new period, so nothing is deleted."""
    if start is not None:
        events = events.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        events = events.where(F.col(ts) < F.lit(end).cast("timestamp"))
    return events


def _averages(requests: Column) -> dict[str, Column]:
    def mean(column: str) -> Column:
        return F.coalesce(F.try_divide(F.col(column).cast("double"), requests), F.lit(0.0))

    return {
        "avg_tokens": mean("total_tokens"),
        "avg_prompt": mean("prompt_tokens"),
        "avg_completion": mean("completion_tokens"),
        "avg_cost": mean("cost"),
    }


def usage_report(events: DataFrame, prices: DataFrame, default_price: float | None = None) -> DataFrame:
    """Requests, tokens, cost and averages per model, and a grand total row whose model is null.

    The events are aggregated once; prices and the total work on the one row per model that is left.
    """
    if default_price is None:
        default_price = fixed.MODEL_PRICES[fixed.DEFAULT_MODEL]
    per_model = events.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in _COUNTS]
    )
    price = F.coalesce("price_per_1k", F.lit(default_price))
    priced = per_model.join(prices, "model", "left").withColumns(
        {"price_per_1k": price, "cost": F.col("total_tokens") / 1000 * price}
    )
    sums = ("requests", *_COUNTS, "cost")
    report = (
        priced.rollup("model")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.max("price_per_1k").alias("_price"),
            F.grouping("model").alias("_total"),
        )
        .withColumn("price_per_1k", F.when(F.col("_total") == 0, F.col("_price")))
    )
    return report.withColumns(_averages(F.col("requests"))).select(
        "model", "price_per_1k", "requests", *_COUNTS, "cost", "avg_tokens", "avg_prompt", "avg_completion",
        "avg_cost", (F.col("_total") == 1).alias("is_total"),
    )


def report_since(responses: DataFrame, prices: DataFrame, reset: str, ts: str = "ts") -> DataFrame:
    """The report after a reset at the given time. Nothing is deleted; what was used before is left out."""
    return usage_report(usage_events(in_period(responses, reset, None, ts)), prices)


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text blocks, models by name and the grand total last."""
    rule = "=" * fixed.REPORT_WIDTH

    def money(column: str) -> Column:
        return F.concat(F.format_string("%.4f", column), F.lit(" ₽"))

    model = F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.REPORT_MODEL), "model"),
        F.format_string(fixed.REPORT_PRICE, "price_per_1k"),
        F.format_string(fixed.REPORT_REQUESTS, "requests"),
        F.concat(F.lit(fixed.REPORT_TOKENS), spaced_number("total_tokens")),
        F.concat(F.lit(fixed.REPORT_PROMPT), spaced_number("prompt_tokens")),
        F.concat(F.lit(fixed.REPORT_COMPLETION), spaced_number("completion_tokens")),
        F.format_string(fixed.REPORT_MEAN, "avg_tokens"),
        F.format_string(fixed.REPORT_MEAN_PROMPT, "avg_prompt"),
        F.format_string(fixed.REPORT_MEAN_COMPLETION, "avg_completion"),
        F.concat(F.lit(fixed.REPORT_COST), money("cost")),
        F.concat(F.lit(fixed.REPORT_MEAN_COST), money("avg_cost")),
    )
    total = F.concat_ws(
        "\n",
        F.lit(f"{rule}\n{fixed.REPORT_ALL}\n{rule}"),
        F.format_string(fixed.REPORT_ALL_REQUESTS, "requests"),
        F.concat(F.lit(fixed.REPORT_ALL_TOKENS), spaced_number("total_tokens")),
        F.concat(F.lit(fixed.REPORT_ALL_COST), money("cost")),
        F.lit(rule),
    )
    block = F.when(F.col("is_total"), total).otherwise(model)
    return report.select("model", "is_total", block.alias("block")).orderBy("is_total", F.asc_nulls_last("model"))


def report_text(report: DataFrame, updated: str) -> DataFrame:
    """The whole report as one text; without any usage it says so. One row per model goes in."""
    lines = report_lines(report.where(F.coalesce("requests", F.lit(0)) > 0))
    ordered = F.array_sort(F.collect_list(F.struct("is_total", "model", "block")))
    head = f"{fixed.REPORT_TITLE}\n{fixed.REPORT_UPDATED}{updated}\n{'=' * fixed.REPORT_WIDTH}\n\n"
    body = lines.agg(F.array_join(ordered["block"], "\n\n").alias("_body"))
    text = F.coalesce(F.nullif("_body", F.lit("")), F.lit(fixed.REPORT_EMPTY))
    return body.select(F.concat(F.lit(head), text, F.lit("\n")).alias("report"))
