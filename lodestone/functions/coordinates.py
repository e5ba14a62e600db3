"""Coordinate cells: a number, a numeric text, a text that holds a list, or a native list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.functions import fixed
from lodestone.functions.binding import bind
from lodestone.functions.text import strip

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_ITEM = rf"(?:{NUMBER}|'[^']*'|\"[^\"]*\")"
# A whole list literal of numbers and quoted texts, a comma after the last item allowed.
LIST_LITERAL = rf"\A\[\s*{_ITEM}(?:\s*,\s*{_ITEM})*\s*,?\s*\]\z"


def cell_item(cell: Column, last: bool) -> Column:
    """First or last item of a cell as trimmed text; a cell that is no list is its own item.

    A quoted item of a well-formed list is taken whole, with any comma it holds.
    """

    def of_literal(cell: Column) -> Column:
        item = F.regexp_extract(cell, rf"{_ITEM}(?=\s*,?\s*\]\z)" if last else rf"\A\[\s*({_ITEM})", 0 if last else 1)
        return strip(F.regexp_replace(item, r"""\A['"]|['"]\z""", ""))

    def of_list(cell: Column) -> Column:
        loose = strip(F.element_at(F.split(F.btrim(cell, F.lit("[]")), ","), -1 if last else 1))
        return F.when(cell.rlike(LIST_LITERAL), of_literal(cell)).otherwise(loose)

    return bind(strip(cell), lambda c: F.when(F.startswith(c, F.lit("[")), of_list(c)).otherwise(c))


def cell_number(cell: Column, last: bool) -> Column:
    """Number in a cell, or null. Words such as `nan` and `inf` are no numbers."""
    return bind(cell_item(cell, last), lambda item: F.when(item.rlike(rf"\A{NUMBER}\z"), item.try_cast("double")))


def coordinate(df: DataFrame, name: str, last: bool) -> Column:
    """The coordinate column as a double, by the type the column has."""
    kind = df.schema[name].dataType
    cell = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return cell.cast("double")
    if isinstance(kind, T.ArrayType):
        return F.try_element_at(cell, F.lit(-1 if last else 1)).try_cast("double")
    return cell_number(cell.cast("string"), last)


def coordinate_text(df: DataFrame, name: str, last: bool) -> Column:
    """The coordinate as text for a summary, without a range check."""
    kind = df.schema[name].dataType
    cell = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        item = F.try_element_at(cell, F.lit(-1 if last else 1)).cast("string")
    else:
        item = cell_item(cell.cast("string"), last)
    return bind(item, lambda i: F.when((i != "") & ~i.isin("nan", "NaN", "None"), i))


def in_range(lon: Column, lat: Column) -> Column:
    return lon.between(*fixed.LON_RANGE) & lat.between(*fixed.LAT_RANGE)


def label(df: DataFrame, columns: Sequence[str] = fixed.LABEL_COLUMNS) -> Column:
    """`name: value` of the label columns that exist and hold a value."""
    parts = [
        F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")))
        for c in columns
        if c in df.columns
    ]
    return F.concat_ws(", ", *parts) if parts else F.lit("")
