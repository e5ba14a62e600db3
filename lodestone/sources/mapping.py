"""Index mappings: the columns of a table as JSON, and the table of features they describe."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone.functions import fixed
from lodestone.functions.vectors import metric_of

# Type of a mapping: its properties by name.
MAPPING = (
    "properties map<string, struct<type: string, "
    "fields: map<string, struct<type: string, ignore_above: int>>, dimension: int, "
    "method: struct<name: string, space_type: string, engine: string>>>"
)

_NUMBERS = {"tinyint": "byte", "smallint": "short", "int": "integer", "bigint": "long"}


def property_of(kind: T.DataType, dimension: int | None = None) -> dict:
    """Mapping entry of a column type."""
    if isinstance(kind, T.StringType):
        keyword = {"type": fixed.KEYWORD_TYPE, "ignore_above": fixed.KEYWORD_LENGTH}
        return {"type": fixed.TEXT_TYPE, "fields": {fixed.KEYWORD_TYPE: keyword}}
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return {
            "type": fixed.VECTOR_TYPE,
            "dimension": dimension or fixed.VECTOR_DIMENSION,
            "method": {"name": fixed.INDEX_METHOD, "space_type": fixed.EMBEDDING_METRIC, "engine": fixed.INDEX_ENGINE},
        }
    if isinstance(kind, T.ArrayType):
        return property_of(kind.elementType)
    if isinstance(kind, (T.StructType, T.MapType)):
        return {"type": "object"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return {"type": "date"}
    name = kind.simpleString()
    return {"type": _NUMBERS.get(name, name)}


def mapping_of(schema: T.StructType, dimension: int | None = None) -> dict:
    return {"properties": {f.name: property_of(f.dataType, dimension) for f in schema}}


def vector_field(mapping: dict) -> str:
    """Name of the vector property of a mapping: by type, else by usual name, else the default."""
    properties = mapping.get("properties", {})
    typed = [name for name, entry in properties.items() if entry.get("type") == "knn_vector"]
    named = [name for name in fixed.VECTOR_NAMES if name in properties]
    return (typed + named + [fixed.DEFAULT_VECTOR])[0]


def text_field(mapping: dict) -> str:
    typed = [name for name, entry in mapping.get("properties", {}).items() if entry.get("type") == "text"]
    return (typed + [fixed.DEFAULT_TEXT])[0]


def metric_of_mapping(mapping: dict) -> str:
    """Metric that the vector property of a mapping names; l2 if it names none."""
    entry = mapping.get("properties", {}).get(vector_field(mapping), {})
    return metric_of(entry.get("method", {}).get("space_type"))


def type_label(kind: Column, fields: Column) -> Column:
    """Type of a property; `unknown` without one, and a note if it has sub-fields."""
    base = F.coalesce(kind, F.lit("unknown"))
    return F.when(fields.isNotNull(), F.concat(base, F.lit(" (keyword)"))).otherwise(base)


def feature_table(mappings: DataFrame, column: str = "mappings", *keep: str) -> DataFrame:
    """One row per property of each mapping text: name, type label, vector dimension and metric."""
    parsed = mappings.select(*keep, F.from_json(column, MAPPING).alias("_m"))
    rows = parsed.select(*keep, F.explode("_m.properties").alias("feature_name", "_p"))
    return rows.select(
        *keep,
        "feature_name",
        type_label(F.col("_p.type"), F.col("_p.fields")).alias("feature_type"),
        F.col("_p.dimension").alias("dimension"),
        F.col("_p.method.space_type").alias("space_type"),
        F.col("_p.method.name").alias("method"),
    )


def list_fields(features: DataFrame, *keys: str) -> DataFrame:
    """Fields by name with their types."""
    return features.select(*keys, "feature_name", "feature_type").orderBy(*keys, "feature_name")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Name and mapping text of each envelope file of a folder."""
    files = spark.read.schema("index_name string, mappings string").option("multiLine", True).json(path)
    return files.select("index_name", F.coalesce("mappings", F.lit("{}")).alias("mappings"))


def mapping_json(schema: T.StructType, dimension: int | None = None) -> str:
    return json.dumps(mapping_of(schema, dimension), ensure_ascii=False)
