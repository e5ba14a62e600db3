"""Joins on ranges, without comparing every row with every other.

An interval is put into bins as wide as the power of two that its length asks for, so it is in two bins at most, however long it is; that power
is its level. A point is in one bin of each level that occurs, of which there are some sixty at most. Points and intervals meet by equal
level and bin, a plain equi-join that Spark sorts, broadcasts or splits like any other, and an exact test keeps the true pairs. Bins are
found by the same division for points and bounds, so none is missed at an edge.

Nulls and intervals that end before they start join nothing.

Where only sums over the points of each interval are wanted, no pair is made: points and bounds are sorted together into ranges, and an interval's
sum is the running total at its end less the one at its start, so the work grows with the rows of both sides and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestone.operators.position import in_ranges

#: Lengths below 2**LOWEST share a level.
LOWEST, HIGHEST = -20, 62


def _number(df: DataFrame, name: str) -> Column:
    """A bound or point as a number whose order is that of its own type; times in microseconds."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # From its parts, so that no zone plays a role.
        seconds = F.hour(column) * 3600 + F.minute(column) * 60 + F.extract(F.lit("SECOND"), column)
        return F.unix_date(column.cast("date")).cast("double") * 86_400_000_000 + (seconds * 1_000_000).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"no range of {kind.simpleString()}: {name}")
    return column.cast("double")


def _bin(number: Column, level: Column) -> Column:
    # A power of two divides exactly, so the order of numbers is kept.
    return F.floor(number / F.pow(F.lit(2.0), level))


def _level(length: Column) -> Column:
    level = F.ceil(F.log2(F.greatest(length, F.pow(F.lit(2.0), F.lit(LOWEST))))).cast("int")
    # The logarithm may be off by a hair at whole powers; a level higher is never wrong.
    return F.least(F.lit(HIGHEST), F.when(F.pow(F.lit(2.0), level) < length, level + 1).otherwise(level))


def interval_join(
    points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[str] = (), closed: bool = False,
    totals: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Rows of `points` with those of `intervals` in which they lie: `start` <= `point` < `end`, or <= `end` if `closed`.

    `on` names columns that must be equal too. All columns of both sides are kept, those of `on` once; other names must differ.

    With `totals` each interval that holds a point comes once, with its own columns and a column for each total: the sum of a column of whole
    numbers of its points, null if they have none, or for None their number.
    """
    clash = (set(points.columns) & set(intervals.columns)) - set(on)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    low, high = _number(intervals, start), _number(intervals, end)
    if totals is not None:
        _number(points, point)
        return _summed(points, intervals.where(low <= high), (point, start, end), on, closed, totals)
    held = intervals.withColumns({"_low": low, "_high": high}).where(F.col("_low") <= F.col("_high"))
    held = held.withColumn("_level", _level(F.col("_high") - F.col("_low")))
    # Some sixty values at most.
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())
    bins = F.sequence(_bin(F.col("_low"), F.col("_level")), _bin(F.col("_high"), F.col("_level")))
    held = held.withColumn("_bin", F.explode(bins)).drop("_low", "_high")
    spread = points.withColumn("_at", _number(points, point)).where(F.col("_at").isNotNull() & ~F.isnan("_at"))
    spread = spread.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    spread = spread.withColumn("_bin", _bin(F.col("_at"), F.col("_level"))).drop("_at")
    joined = spread.join(held, [*on, "_level", "_bin"])
    inside = F.col(f"`{point}`") >= F.col(f"`{start}`")
    inside = inside & (F.col(f"`{point}`") <= F.col(f"`{end}`") if closed else F.col(f"`{point}`") < F.col(f"`{end}`"))
    return joined.where(inside).drop("_level", "_bin")


def _place(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    # Zero is one place, whatever its sign.
    return column + F.lit(0.0) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else column


def _summed(
    points: DataFrame, intervals: DataFrame, names: tuple[str, str, str], on: Sequence[str], closed: bool, totals: Mapping[str, str | None]
) -> DataFrame:
    """Totals of the points of each interval, by running totals over points and bounds in one order."""
    point, start, end = names
    keys = {f"_k{n}": c for n, c in enumerate(on)}
    measures = [c for c in totals.values() if c is not None]
    if not all(isinstance(points.schema[c].dataType, T.IntegralType) for c in measures):
        raise ValueError(f"totals are of whole numbers: {measures}")
    # Exact however large the running totals get.
    sums = {"_n": F.count(F.lit(1)).cast("decimal(38,0)")}
    for n, c in enumerate(measures):
        sums |= {f"_s{n}": F.sum(F.col(f"`{c}`").cast("decimal(38,0)")), f"_c{n}": F.count(f"`{c}`").cast("decimal(38,0)")}
    before, at, after = F.lit(0), F.lit(1), F.lit(2)

    def keyed(df: DataFrame, name: str, side: Column) -> DataFrame:
        rows = df.select("*", *[F.col(f"`{c}`").alias(k) for k, c in keys.items()], _place(df, name).alias("_at"), side.alias("_side"))
        return rows.dropna(subset=[*keys, "_at"])

    # One row for each place, so no range is one place of very many rows; a start is before the points of its place.
    held = keyed(points, point, at)
    if isinstance(points.schema[point].dataType, (T.FloatType, T.DoubleType)):
        held = held.where(~F.isnan("_at"))
    order = [*keys, "_at", "_side"]
    rows = held.groupBy(*order).agg(*[c.alias(n) for n, c in sums.items()])
    starts, ends = keyed(intervals, start, before).select(*order), keyed(intervals, end, after if closed else before).select(*order)
    rows = rows.unionByName(starts.unionByName(ends).distinct(), allowMissingColumns=True)
    sorted_rows = in_ranges(rows, order, "totals")
    inside = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range: a window over them all is small, and so is the broadcast.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sorted_rows.groupBy("_range").agg(*[F.sum(n).alias(n) for n in sums])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b{n}") for n in sums])
    running = sorted_rows.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}).where("_side <> 1")
    running = running.join(F.broadcast(ranges), "_range").select(*order, *[(F.col(n) + F.col(f"_b{n}")).alias(n) for n in sums])

    def looked_up(df: DataFrame, name: str, side: Column, prefix: str) -> DataFrame:
        found = running.select(*order, *[F.col(n).alias(prefix + n) for n in sums])
        return keyed(df, name, side).join(found, order).drop(*order)

    both = looked_up(looked_up(intervals, start, before, "_lo"), end, after if closed else before, "_hi")
    inner = {n: F.col(f"_hi{n}") - F.col(f"_lo{n}") for n in sums}
    place = iter(range(len(measures)))
    out = {}
    for name, c in totals.items():
        n = None if c is None else next(place)
        out[name] = (inner["_n"] if n is None else F.when(inner[f"_c{n}"] > 0, inner[f"_s{n}"])).cast("bigint")
    return both.where(inner["_n"] > 0).select(*[F.col(f"`{c}`") for c in intervals.columns], *[c.alias(name) for name, c in out.items()])


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides whose intervals [start, end) share a moment: one of them starts in the other, and both at once counted once."""
    (a, b), (c, d) = left_range, right_range
    whole_left, whole_right = (side.where(F.col(f"`{x}`") < F.col(f"`{y}`")) for side, (x, y) in ((left, left_range), (right, right_range)))
    in_right = interval_join(whole_left, whole_right, a, c, d, on)
    in_left = interval_join(whole_right, whole_left, c, a, b, on).where(F.col(f"`{c}`") > F.col(f"`{a}`"))
    return in_right.unionByName(in_left)
