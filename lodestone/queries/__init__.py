"""Queries over the driver's tables, by area."""

from lodestone.queries import answers, logs, points, roundtrips, streams, tables, texts, vectors  # noqa: F401
from lodestone.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
