"""Attempt logs of outside models: what to do next, and what has been tried."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import fixed
from lodestone.functions.text import contains_any, is_yes


def retry_allowed(
    error: Column,
    attempt: Column,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    words: Sequence[str] | None = fixed.RETRY_WORDS,
) -> Column:
    """Whether a failed attempt may be made again; without `words`, any error allows it."""
    slow = F.lit(True) if words is None else contains_any(F.lower(error), words)
    return error.isNotNull() & slow & (attempt < max_attempts)


def next_step(
    error: Column,
    attempt: Column,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    words: Sequence[str] | None = fixed.RETRY_WORDS,
) -> Column:
    """`accept` a response, `retry` a failed one while that is allowed, else `reject`."""
    return (
        F.when(error.isNull(), "accept")
        .when(retry_allowed(error, attempt, max_attempts, words), "retry")
        .otherwise("reject")
    )


def retry_delay(
    error: Column,
    attempt: Column,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    words: Sequence[str] | None = fixed.RETRY_WORDS,
    first: int = fixed.FIRST_RETRY_DELAY,
) -> Column:
    """Seconds before the next attempt; the delay doubles each time."""
    delay = (first * F.pow(F.lit(2.0), attempt - 1)).cast("long")
    return F.when(retry_allowed(error, attempt, max_attempts, words), delay)


def one_per_attempt(log: DataFrame, keys: Sequence[str], max_attempts: int) -> DataFrame:
    """One row per key and attempt, so that no key holds more than `max_attempts` rows.

    A log may hold an attempt more than once; the copies are equal or the greatest one counts. The
    aggregation runs before the shuffle too, so a key with many copies does not load one task.
    """
    rest = [c for c in log.columns if c not in (*keys, "attempt")]
    return (
        log.where(F.col("attempt").between(1, max_attempts))
        .groupBy(*keys, "attempt")
        .agg(F.max(F.struct(*rest)).alias("_row"))
        .select(*keys, "attempt", "_row.*")
    )


def resolve_verdicts(
    responses: DataFrame,
    keys: Sequence[str],
    max_attempts: int = fixed.MAX_ATTEMPTS,
    words: Sequence[str] = fixed.YES_WORDS,
) -> DataFrame:
    """Verdict per key from the log (keys, attempt, text, error): that of the first final attempt.

    A key without a final attempt is not accepted.
    """
    step = next_step(F.col("error"), F.col("attempt"), max_attempts)
    yes = (F.col("_step") == "accept") & is_yes(F.col("text"), words)
    return (
        responses.where(F.col("attempt") <= max_attempts)
        .withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.min_by(
                F.when(F.col("_step") != "retry", yes),
                F.when(F.col("_step") != "retry", F.col("attempt")),
            ).alias("_yes")
        )
        .select(*keys, F.coalesce("_yes", F.lit(False)).alias("accepted"))
    )


def bindings_text(bindings: Column) -> Column:
    """Candidate names as a list for a prompt."""
    lines = F.transform(bindings, lambda b: F.concat(F.lit("- `"), b, F.lit("`")))
    return F.when(F.size(bindings) > 0, F.array_join(lines, "\n")).otherwise(F.lit(fixed.NO_BINDINGS))


def attempt_state(
    log: DataFrame, keys: Sequence[str], max_attempts: int = fixed.MAX_ATTEMPTS
) -> DataFrame:
    """State of each key's attempts, from the log (keys, attempt, sql, ok, error, bindings).

    Gives the accepted statement, the status (`accepted`, `retry`, `rejected`), the next template, the
    last error, and the history and candidate names that the last template shows.
    """
    tries = one_per_attempt(log, keys, max_attempts)
    row = F.struct("attempt", "ok", "sql", "error", "bindings")
    # At most `max_attempts` rows per key are left, so the list is short.
    held = tries.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_tries"))
    # As columns of their own, both are found once for all that is made of them.
    held = held.withColumn("_won", F.get(F.filter("_tries", lambda t: t["ok"]), F.lit(0)))
    open_until = F.coalesce("_won.attempt", F.lit(max_attempts + 1))
    held = held.withColumn("_failed", F.filter("_tries", lambda t: ~t["ok"] & (t["attempt"] < open_until)))

    def told(t: Column) -> Column:
        error = F.coalesce(t["error"], F.lit(fixed.UNKNOWN_ERROR))
        first = F.concat(F.lit("Попытка "), t["attempt"].cast("string"), F.lit(": "), error)
        names = F.concat(F.lit("\nДоступные колонки: "), F.array_join(t["bindings"], ", "))
        return F.when(F.size(t["bindings"]) > 0, F.concat(first, names)).otherwise(first)

    failures = F.size("_failed")
    names = F.flatten(F.transform("_failed", lambda t: F.coalesce(t["bindings"], F.array().cast("array<string>"))))
    status = (
        F.when(F.col("_won").isNotNull(), "accepted")
        .when(failures >= max_attempts, "rejected")
        .otherwise("retry")
    )
    history = F.array_join(F.transform("_failed", told), "\n")
    return held.select(
        *keys,
        status.alias("status"),
        F.col("_won.attempt").alias("accepted_attempt"),
        F.col("_won.sql").alias("sql"),
        failures.alias("failures"),
        F.when(status == "retry", F.least(failures + 1, F.lit(3))).alias("next_template"),
        F.try_element_at("_failed", F.lit(-1))["error"].alias("last_error"),
        F.when(failures > 0, history).otherwise(F.lit(fixed.NO_HISTORY)).alias("error_history"),
        F.array_sort(F.array_distinct(names)).alias("bindings"),
    )
