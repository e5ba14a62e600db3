"""Vector expressions on array columns, for scoring pairs that are already together in a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions.binding import bind

METRICS = ("cosine", "l2", "inner")
# Names that an index mapping uses for the metrics.
SPACE_TYPES = {
    "cosinesimil": "cosine",
    "cosinesimilarity": "cosine",
    "l2": "l2",
    "innerproduct": "inner",
}


def metric_of(space_type: str | None) -> str:
    """Metric of a mapping; a mapping that names none means l2."""
    return SPACE_TYPES.get(space_type or "l2", "l2")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""

    def scaled(length: Column) -> Column:
        by = F.when(length > 0, length).otherwise(F.lit(1.0))
        return F.transform(a, lambda x: x.cast("double") / by)

    return bind(norm(a), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, or null where one of the vectors has no length."""
    return bind(norm(a) * norm(b), lambda lengths: F.when(lengths > 0, dot(a, b) / lengths))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))),
            F.lit(0.0),
            lambda total, x: total + x,
        )
    )
