"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `root`: the smallest node that each node of `links(a, b)` is connected with.

    Each round points every node's larger neighbours, then its smaller ones, to the smallest neighbour. A hub is
    aggregated before the shuffle and its links are spread by the join, so none is gathered in a task. Rounds are
    stored tables; their number grows with the logarithm of the number of nodes.
    """
    edges = Stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        stored = Stored(large, "links")
        edges.drop()
        low = _least(stored.df)
        small = (
            stored.df.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        )
        edges = Stored(small, "links")
        stored.drop()
        row = edges.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    stars = edges.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
