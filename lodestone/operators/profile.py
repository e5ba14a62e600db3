"""Schema discovery and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.functions import fixed
from lodestone.functions.vectors import norm


def vector_column(schema: T.StructType) -> str:
    """The first list of floating numbers; else the first usual name present; else the default."""
    for field in schema:
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return field.name
    for name in fixed.VECTOR_NAMES:
        if name in schema.names:
            return name
    return fixed.DEFAULT_VECTOR


def text_column(schema: T.StructType) -> str:
    for field in schema:
        if isinstance(field.dataType, T.StringType):
            return field.name
    return fixed.DEFAULT_TEXT


def require_columns(df: DataFrame, names: Sequence[str] = ("embedding", "text")) -> DataFrame:
    """Raise before any job if a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Raise if the table is empty; reads at most one row."""
    if df.isEmpty():
        raise ValueError("the table holds no rows")
    return df


def present(df: DataFrame, name: str) -> Column:
    """True where the column holds a value; nan counts as none."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def column_profile(df: DataFrame) -> DataFrame:
    """Position, name, type, non-null count and row count of every column, from one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count_if(present(df, c)) for c in df.columns]).alias("filled"),
    )
    facts = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype")) for f in df.schema]
    )
    return counts.select("total", F.posexplode(F.arrays_zip("filled", facts.alias("facts")))).select(
        F.col("pos").alias("position"),
        F.col("col.facts.name").alias("column_name"),
        F.col("col.facts.dtype").alias("dtype"),
        F.col("col.filled").alias("non_null"),
        "total",
    )


def profile_line(name: Column, dtype: Column, non_null: Column, total: Column) -> Column:
    return F.format_string("- `%s` (%s, заполнено: %d/%d)", name, dtype, non_null, total)


def profile_text(profile: DataFrame) -> DataFrame:
    """The profile as one text, a line per column in column order. One row per column goes in."""
    line = profile_line(F.col("column_name"), F.col("dtype"), F.col("non_null"), F.col("total"))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return profile.agg(F.array_join(lines["line"], "\n").alias("columns_info"))


def vector_health(df: DataFrame, vec_col: str = "embedding", *keys: str) -> DataFrame:
    """Counts of missing, empty, zero and valid vectors, and the range of sizes and lengths."""
    vec = F.col(f"`{vec_col}`")
    size = F.when(vec.isNotNull(), F.size(vec))
    length = F.when(size > 0, norm(vec))
    facts = df.select(*keys, size.alias("_size"), length.alias("_length"))
    return (
        facts.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("_size").isNull()).alias("missing"),
            F.count_if(F.col("_size") == 0).alias("empty"),
            F.count_if(F.col("_length") == 0).alias("zero"),
            F.min("_size").alias("min_size"),
            F.max("_size").alias("max_size"),
            F.min("_length").alias("min_length"),
            F.max("_length").alias("max_length"),
        )
        .withColumn("ragged", F.col("min_size") != F.col("max_size"))
    )
