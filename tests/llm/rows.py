"""Small tables of documents."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None, ids=None):
    """Documents with the given texts; ids count from 0 unless given."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["a"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(words: int, seed: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def clashing(df):
    """The same rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("did", "rk", "fp", "score", "copies", "value", "body", "words", "_source", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
