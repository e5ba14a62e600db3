"""Building the column catalog: features, prompts, descriptions, vectors, documents."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.functions import fixed, templates
from lodestone.functions.text import catalog_text, generation_failed, strip
from lodestone.operators.position import with_row_position
from lodestone.operators.reconcile import remaining
from lodestone.sources.envelope import Load, import_documents


def catalog_prompts(features: DataFrame, template: str = templates.DESCRIBE_FEATURE) -> DataFrame:
    """The prompt that asks for a description of each feature."""
    places = {"feature_name": "feature_name", "feature_type": "feature_type"}
    return features.withColumn("prompt", templates.fill(template, places))


def with_descriptions(
    features: DataFrame, responses: DataFrame, max_attempts: int = fixed.MAX_ATTEMPTS
) -> DataFrame:
    """Join the first good response (feature_name, attempt, text, error), else a failure marker."""
    attempt = F.col("attempt")
    good = F.when(F.col("error").isNull(), attempt)
    picked = (
        responses.where(attempt <= max_attempts)
        .groupBy("feature_name")
        .agg(F.min_by("text", good).alias("_text"), F.max_by("error", attempt).alias("_error"))
    )
    failure = F.concat(F.lit(fixed.FAILURE_MARKER), F.coalesce("_error", F.lit("")))
    return (
        features.join(picked, "feature_name", "left")
        .withColumn("description", F.coalesce(strip("_text"), failure))
        .drop("_text", "_error")
    )


def attach_vectors(items: DataFrame, vectors: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """Join supplied vectors; an item without one gets an empty vector."""
    empty = F.array().cast(vectors.schema[vec_col].dataType)
    return items.join(vectors.select(key, vec_col), key, "left").withColumn(vec_col, F.coalesce(vec_col, empty))


def embed(items: DataFrame, text: str, function: Callable[[list[str]], list[list[float]]], out: str = "embedding"):
    """Vectors from a function of the caller, in Arrow batches.

    A batch that fails is asked for text by text, so only a text that fails by itself gets an empty vector. What a caller's function
    may raise is not known here, so any error counts, but for those that end the process.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[float]:
            try:
                return list(function([t])[0])
            except Exception as error:
                warnings.warn(f"no vector for a text of {len(t)} characters: {type(error).__name__}: {error}", stacklevel=1)
                return []

        try:
            found = list(function(texts.tolist()))
        except Exception:
            found = None
        if found is None or len(found) != len(texts):
            found = [one(t) for t in texts]
        return pd.Series(found)

    return items.withColumn(out, vectors(F.coalesce(text, F.lit(""))))


def catalog_documents(described: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Catalog documents (`_id`, `_source`), numbered from 0 in the order of the feature names.

    The vector is that of the description alone, while the text holds the name too.
    """
    items = described if vectors is None else attach_vectors(described, vectors, "feature_name")
    numbered = with_row_position(items, ["feature_name"], "_position")
    return numbered.select(
        (F.col("_position") - 1).cast("string").alias("_id"),
        F.struct(catalog_text("feature_name", "description").alias("text"), F.col("embedding")).alias("_source"),
        "feature_name",
        generation_failed("description").alias("failed"),
    )


def build_catalog(
    features: DataFrame, responses: DataFrame, vectors: DataFrame, path: str, finished: DataFrame | None = None
) -> Load:
    """Describe and store the features that `finished` does not name; failed ones are left for another run.

    With `finished` the documents are added to what is stored at `path`; without, they replace it.
    """
    documents = catalog_documents(with_descriptions(features, responses), vectors).where(~F.col("failed"))
    if finished is not None:
        documents = remaining(documents, finished, ["feature_name"])
    return import_documents(documents.select("_id", "_source"), path, "overwrite" if finished is None else "append")
