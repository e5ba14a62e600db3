"""Evaluate an expression once and use it many times.

Spark inlines a named column wherever it is used, so an expensive one that several conditions share would be
computed for each. A lambda variable is bound to the computed value instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` applied to the value, which is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
