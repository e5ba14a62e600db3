"""Registered queries: a Spark plan over the driver's tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import read_table, share_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a directory by attribute: `t.documents`."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)


def query(sql: str | None = None) -> Callable:
    """Register a function of `Tables` under its name, with the SQL that gives the same rows."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        name = function.__name__
        QUERIES[name] = partial(_run, function)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _run(function: Callable[[Tables], DataFrame], spark: SparkSession, directory: str) -> DataFrame:
    share_package(spark)
    return function(Tables(spark, directory))
