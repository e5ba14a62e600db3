"""The retrieved-data block and the texts of an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import fixed
from lodestone.functions.text import ensure_mention


def first_rows(rows: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key. Each map task keeps n rows per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)


def row_text(columns: Sequence[str]) -> Column:
    """A row as one line; a missing value is empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(" | ", *cells)


def data_block(
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order_by: Sequence[Column],
    max_rows: int = fixed.BLOCK_ROWS,
) -> DataFrame:
    """Per key: the true number of rows, and a text of a header and the first rows."""
    shown = first_rows(rows, keys, order_by, max_rows).select(*keys, "_rank", row_text(columns).alias("_line"))
    # At most `max_rows` lines per key.
    lines = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "_line"))).alias("_lines"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("results_count"))
    table = F.concat(F.lit(" | ".join(columns) + "\n"), F.array_join(F.col("_lines._line"), "\n"))
    more = F.concat(
        F.lit("Найдено "), F.col("results_count").cast("string"),
        F.lit(f" записей. Показаны первые {max_rows}:\n\n"),
    )
    block = F.when(F.col("results_count") > max_rows, F.concat(more, table)).otherwise(table)
    return counts.join(lines, list(keys)).select(*keys, "results_count", block.alias("retrieved_data"))


def lines_note(lines: Column, total: Column) -> Column:
    """How many of all lines are shown, if not all are."""
    first, second = fixed.LINES_SHOWN
    note = F.concat(F.lit(f"\n{first}"), F.size(lines).cast("string"), F.lit(second), total.cast("string"))
    return F.when(total > F.size(lines), note).otherwise(F.lit(""))


def points_section(lines: Column, total: Column | None = None) -> Column:
    """Section of coordinate lines, or the note that there are none. `total` is the number of all lines, if some are not shown."""
    rule = "=" * fixed.RULE_WIDTH
    head = F.lit(f"\n\n{rule}\n{fixed.POINTS_TITLE}\n{rule}\n")
    note = lines_note(lines, F.size(lines) if total is None else total)
    full = F.concat(head, F.array_join(lines, "\n"), note, F.lit(f"\n{rule}"))
    return F.when(F.size(lines) > 0, full).otherwise(F.lit(fixed.NO_POINTS_BLOCK))


def with_points(answer: Column, lines: Column, total: Column | None = None) -> Column:
    """Append the coordinate lines to an answer that mentions none."""
    bullets = F.transform(lines, lambda line: F.replace(line, F.lit("Запись "), F.lit("• ")))
    note = lines_note(lines, F.size(lines) if total is None else total)
    text = F.concat(F.lit(f"\n\n📍 {fixed.POINTS_TITLE}\n"), F.array_join(bullets, "\n"), note)
    return ensure_mention(answer, F.size(lines) > 0, text, fixed.COORDINATE_MENTIONS)


def shown_lines(lines: DataFrame, keys: Sequence[str], max_lines: int = fixed.BLOCK_ROWS) -> DataFrame:
    """Per key: the number of all lines, `lines_total`, and the first ones as `lines`."""
    first = first_rows(lines, keys, [F.col("position").asc()], max_lines)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_l"))
    total = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines_total"))
    return total.join(shown, list(keys)).select(*keys, "lines_total", F.col("_l.line").alias("lines"))


def fallback_answer(results_count: Column, block: Column, section: Column) -> Column:
    """Answer without a model: the data itself, or that there is none."""
    found = F.concat(
        F.lit("Найдено "), results_count.cast("string"), F.lit(" записей:\n\n"), block, F.coalesce(section, F.lit(""))
    )
    return F.when(F.coalesce(results_count, F.lit(0)) == 0, F.lit(fixed.NO_ROWS_ANSWER)).otherwise(found)
