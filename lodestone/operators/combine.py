"""Union of differently shaped results, with the source of each row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_WIDENING = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def common_type(kinds: list[T.DataType], mixed: T.DataType = T.StringType()) -> T.DataType:
    """The one type all branches share, the widest number if all are numbers, else `mixed`: text, or a variant that keeps each value."""
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    if not known:
        return T.StringType()
    if all(k == known[0] for k in known):
        return known[0]
    if all(isinstance(k, _WIDENING) for k in known):
        widest = max(known, key=lambda k: _WIDENING.index(type(k)))
        # A float cannot hold every long.
        return T.DoubleType() if isinstance(widest, T.FloatType) else widest
    return mixed


def as_text(column, kind: T.DataType):
    """Text of a value; lists, maps and structs as JSON."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def as_variant(column, kind: T.DataType):
    """A value as a variant, which is still a number, a list or a text."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_variant_object(column)
    return column.cast("variant")


def mixed_value(column: Column | str) -> Column:
    """What a variant holds, by type: `kind` (its schema), `number`, `truth`, `text`, and `json` of lists and objects."""
    value = F.col(column) if isinstance(column, str) else column
    kind = F.schema_of_variant(value)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.struct(
        kind.alias("kind"),
        F.when(number, F.try_variant_get(value, "$", "double")).alias("number"),
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias("truth"),
        F.when(~nested & ~number & (kind != "BOOLEAN"), F.try_variant_get(value, "$", "string")).alias("text"),
        F.when(nested, F.to_json(value)).alias("json"),
    )


def unique_names(names: Sequence[str], taken: Sequence[str] = ()) -> list[str]:
    """Each name once, without regard to case: a name that is taken gets a number."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        free, number = name, 2
        while free.lower() in seen:
            free, number = f"{name}_{number}", number + 1
        seen.add(free.lower())
        out.append(free)
    return out


class Columns:
    """Columns of several branches by name, by the session's rule for case; the first spelling of a name stays.

    A column whose branches disagree is text, or with `variant` keeps the values as they are.
    """

    def __init__(self, spark: SparkSession, variant: bool = False):
        self.mixed = T.VariantType() if variant else T.StringType()
        self.exact = spark.conf.get("spark.sql.caseSensitive", "false") == "true"
        self.names: dict[str, str] = {}
        self.kinds: dict[str, list[T.DataType]] = {}

    def key(self, name: str) -> str:
        return name if self.exact else name.lower()

    def add(self, schema: T.StructType) -> None:
        for field in schema:
            key = self.key(field.name)
            self.names.setdefault(key, field.name)
            found = self.kinds.setdefault(key, [])
            if field.dataType not in found:
                found.append(field.dataType)

    def aligned(self, df: DataFrame) -> list[Column]:
        """All columns for a branch; those that it lacks are null."""
        own = {self.key(f.name): f for f in df.schema}
        out = []
        for key, name in self.names.items():
            wanted = common_type(self.kinds[key], self.mixed)
            if key not in own:
                out.append(F.lit(None).cast(wanted).alias(name))
                continue
            field = own[key]
            column = F.col(f"`{field.name}`")
            if field.dataType != wanted:
                if wanted == T.VariantType():
                    column = as_variant(column, field.dataType)
                else:
                    column = as_text(column, field.dataType) if wanted == T.StringType() else column.cast(wanted)
            out.append(column.alias(name))
        return out


def tagged_union(branches: Mapping[str, DataFrame], tag: str = "matched_feature", variant: bool = False) -> DataFrame:
    """Bag union by column name. `tag` holds the branch; a missing column is null, and a name that a branch has twice is numbered.

    Where branches have different types of a column it becomes text, or with `variant` a variant, in which numbers stay
    numbers and lists lists (`mixed_value` reads them). Column types are settled from the schemas first, so the union cannot fail on a value at run time.
    """
    if not branches:
        raise ValueError("nothing to combine")
    columns = Columns(next(iter(branches.values())).sparkSession, variant)
    parts = {}
    for name, df in branches.items():
        own = df.drop(tag) if tag in df.columns else df
        parts[name] = own.toDF(*unique_names(own.columns)) if not columns.exact else own
        columns.add(parts[name].schema)
    return reduce(DataFrame.unionAll, [df.select(*columns.aligned(df), F.lit(name).alias(tag)) for name, df in parts.items()])
