"""Vector-layer records: features with a geometry and a map of attributes.

The geometry files themselves are decoded elsewhere; their JSON form is read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions.coordinates import NUMBER
from lodestone.sources.objects import read_items

FEATURE = "id bigint, geometry_wkt string, geometry_type int, attributes map<string,string>"
PROJECT_FEATURE = "struct<id: bigint, geometry_wkt: string, attributes: map<string,string>>"


def read_features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Features of a layer, from JSON lines or from files that hold one list."""
    return spark.read.schema(FEATURE).option("multiLine", not lines).json(path)


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Features of all layers of a project, `{layer: [feature]}` per file, read by ranges of it; no geometry type is given."""
    features = read_items(spark, path).select(F.col("key").alias("layer"), F.from_json("item", PROJECT_FEATURE).alias("_f"))
    return features.select("layer", "_f.id", "_f.geometry_wkt", "_f.attributes")


def attributes_long(features: DataFrame, *keep: str) -> DataFrame:
    """One row per feature and attribute."""
    return features.select(*keep, F.explode("attributes").alias("attribute", "value"))


def plain_value(value: Column, kind: str) -> Column:
    """A stored text as a value of its type; null if it is none."""
    return value.try_cast(kind)


def value_type(value: Column) -> Column:
    """Narrowest type of an attribute's text."""
    # A pattern is cheaper than a cast that fails.
    whole = value.rlike(r"\A[+-]?\d+\z")
    return (
        F.when(whole & value.try_cast("bigint").isNotNull(), "integer")
        .when(value.rlike(rf"\A{NUMBER}\z"), "real")
        .otherwise("string")
    )


def layer_profile(features: DataFrame, *keys: str) -> DataFrame:
    """Features per layer and geometry type; a feature without geometry has no type."""
    return features.groupBy(*keys, "geometry_type").agg(
        F.count(F.lit(1)).alias("features"), F.count("geometry_wkt").alias("with_geometry")
    )


def attribute_profile(features: DataFrame, *keys: str) -> DataFrame:
    """Attributes per layer with their type: the widest of the types of their values."""
    rank = F.array(F.lit("integer"), F.lit("real"), F.lit("string"))
    kind = F.array_position(rank, value_type(F.col("value")))
    return (
        attributes_long(features, *keys)
        .groupBy(*keys, "attribute")
        .agg(F.count("value").alias("filled"), F.max(F.when(F.col("value").isNotNull(), kind)).alias("_kind"))
        .select(*keys, "attribute", "filled", F.get(rank, (F.col("_kind") - 1).cast("int")).alias("value_type"))
    )
