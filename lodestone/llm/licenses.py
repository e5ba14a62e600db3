"""License scans by diagonal voting.

Every rolling 4-gram of a document's words is joined by its hash with the places of the same gram in license templates. A match votes for
its diagonal (place in the document less place in the template). Votes are aggregated by diagonal; diagonals that differ by at most
`GAP` are merged, as a few words put in or left out shift the rest; and each merged band is verified: the share of the template's
words that the band's grams cover must reach `COVERAGE`, on a stretch of a plausible length, and the gram that tells a licence from its
neighbours must be among them. Bands add their labels to those of the base phrases, which are found word by word in the same pass.

Only built-in functions run here. Templates are a fixed list, so their broadcast is bounded. Grams of a document are
rows of their own, so no document or template gathers matches in one task before they are aggregated.

Null and empty texts have no words, no labels and the score 0. A very long text is split into words within its row, a few copies of
them in turn; its grams are rows. Rows of equal id are scanned each for itself by id and text;
equal rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, keyed, public_id

#: Base phrases and their labels; fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label and text of notices; each is a template. Where notices of neighbouring licences differ by a word, four words in a row are named that
#: tell this one apart: a band without them is not of this licence, whatever else it covers.
TEMPLATES = (
    ("mit", "Released under the MIT License", None),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", None),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", None),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", None),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "public license version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public license"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public"),
    ("lgpl", "under the terms of the GNU Library General Public License as published by the Free Software Foundation", "gnu library general public"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", "creative commons attribution 3"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons attribution sharealike 4"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "commons attribution sharealike 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "by nc 4 0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial 4"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "attribution noncommercial sharealike 4"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "attribution noncommercial noderivatives 4"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "commons attribution noderivatives 4"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", None),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", None),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", None),
    ("unlicense", "This is free and unencumbered software released into the public domain", None),
)
GRAM = 4
GAP = 3
COVERAGE = 0.8
#: The longest stretch of a document for one template, in lengths of the template.
STRETCH = 1.5
#: What parts words: all below \x80 but digits and lower-case letters.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return [w for w in re.split(PARTING, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def words_column(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), PARTING), "")


def _grams(templates) -> list[tuple]:
    """The words of each gram, its template and place, the template's length, the place of the gram that it needs (or none), and its label."""
    rows = []
    for number, (label, text, needed) in enumerate(templates):
        words = words_of(text)
        grams = [words[i : i + GRAM] for i in range(len(words) - GRAM + 1)]
        need = None if needed is None else grams.index(needed.split())
        rows += [(*gram, number, place, len(words), need, label) for place, gram in enumerate(grams)]
    return rows


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """`gram`, `template`, `place`, `length`, `need`, `license`: a row for each place of a gram in a template."""
    kinds = [*(f"w{i} string" for i in range(GRAM)), "template int", "place int", "length int", "need int", "license string"]
    frame = spark.createDataFrame(_grams(templates), ", ".join(kinds))
    return frame.select(F.xxhash64(*(f"w{i}" for i in range(GRAM))).alias("gram"), "template", "place", "length", "need", "license")


def _base(words: list[Column]) -> Column:
    found = F.lit(None).cast("string")
    for phrase, label in BASE.items():
        hit = F.lit(True)
        for word, wanted in zip(words, phrase.split(), strict=False):
            hit = hit & (word == wanted)
        found = F.when(hit, F.lit(label)).otherwise(found)
    return found


def scan(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Base places (`did`, `rk`, `i`, `base`) and verified bands (`did`, `rk`, `license`, `first`, `last`, `score`)."""
    spark = docs.sparkSession
    rows = keyed(docs).select("did", "rk", words_column(F.col("body").cast("string")).alias("words"))
    # Word i and the three behind it; beyond the last word they are null.
    shifted = [F.col("words"), *(F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) for i in range(1, GRAM))]
    grams = rows.where(F.size("words") > 1).select("did", "rk", F.posexplode(F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted)))).alias("i", "g"))
    word = [F.col(f"g.w{i}") for i in range(GRAM)]
    matched = (
        grams.select("did", "rk", "i", _base(word).alias("base"), F.when(word[-1].isNotNull(), F.xxhash64(*word)).alias("gram"))
        .join(F.broadcast(template_grams(spark, templates)), "gram", "left")
        .where(F.col("base").isNotNull() | F.col("template").isNotNull())
        .select("did", "rk", "i", "base", "template", "place", "length", "need", "license")
    )
    hits = Stored(matched, "license-hits").df
    # Several places of one gram in a template give a word several rows; rows of one key are equal texts.
    base = hits.where("base IS NOT NULL").select("did", "rk", "i", "base").distinct()
    return base, bands(hits.where("template IS NOT NULL").select("did", "rk", "i", "template", "place", "length", "need", "license").distinct())


def bands(votes: DataFrame) -> DataFrame:
    by = ["did", "rk", "template", "length", "need", "license"]
    diagonals = votes.withColumn("diagonal", F.col("i") - F.col("place")).groupBy(*by, "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("i").alias("first"), F.max("i").alias("last")
    )
    order = Window.partitionBy("did", "rk", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int")
    merged = (
        diagonals.withColumn("band", F.sum(F.coalesce(new, F.lit(0))).over(order))
        .groupBy(*by, "band").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1))))
    return (
        merged.withColumn("score", F.size(covered) / F.col("length"))
        .where(F.col("need").isNull() | F.array_contains("places", F.col("need")))
        .where((F.col("score") >= COVERAGE) & (F.col("last") + GRAM - F.col("first") <= F.ceil(F.col("length") * STRETCH)))
        .select("did", "rk", "license", "first", F.col("last") + GRAM - 1, "score").toDF("did", "rk", "license", "first", "last", "score")
    )


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """`doc_id`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`, one row per document.

    `score` is 1 where a base phrase stands, else the best verified band's share of covered words, else 0.
    """
    base, found = scan(docs, templates)
    places = base.groupBy("did", "rk").agg(
        F.count("*").alias("n_base"), F.min("i").alias("first_word"), F.max("i").alias("last_word"),
        F.collect_set("base").alias("base_set"),
    )
    labels = found.groupBy("did", "rk").agg(F.collect_set("license").alias("set"), F.max("score").alias("best"))
    result = places.join(labels, ["did", "rk"], "full")
    none = F.array().cast("array<string>")
    return (
        keyed(docs).select("did", "rk", F.size(words_column(F.col("body").cast("string"))).cast("long").alias("n_words"))
        .join(result, ["did", "rk"], "left")
        .select(
            public_id(), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            F.col("first_word").cast("long"), F.col("last_word").cast("long"),
            F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("set", none))), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )


def license_sql(templates=TEMPLATES) -> str:
    """The same in SQL; grams are compared by their words. Ids must be unique."""
    values = ", ".join(
        "(" + ", ".join([*(f"'{w}'" for w in ws), str(t), str(i), str(n), "NULL" if need is None else str(need), f"'{label}'"]) + ")"
        for *ws, t, i, n, need, label in _grams(templates)
    )
    cases = " ".join(
        "WHEN " + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(phrase.split())) + f" THEN '{label}'" for phrase, label in BASE.items()
    )
    columns = ", ".join(f"w{i}" for i in range(GRAM))
    shifted = ", ".join(f"words[i + {k + 1}] AS w{k}" for k in range(GRAM))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
g AS (SELECT doc_id, i, {shifted} FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM d)),
t({columns}, template, place, length, need, license) AS (VALUES {values}),
b AS (SELECT doc_id, i, CASE {cases} END AS base FROM g),
bs AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT base) AS labels
  FROM b WHERE base IS NOT NULL GROUP BY doc_id),
v AS (SELECT DISTINCT doc_id, i, template, place, length, need, license, i - place AS diagonal FROM g JOIN t USING ({columns})),
n AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS new FROM v),
m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS band FROM n),
c AS (
  SELECT doc_id, template, license, length, band, min(i) AS first, max(i) AS last,
    len(list_distinct(flatten(list(range(place, place + {GRAM}))))) / length AS score, bool_or(need IS NULL OR place = need) AS own
  FROM m GROUP BY doc_id, template, license, length, band),
f AS (
  SELECT doc_id, list(DISTINCT license) AS labels, max(score) AS best FROM c
  WHERE own AND score >= {COVERAGE} AND last + {GRAM} - first <= ceil(length * {STRETCH}) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(bs.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN f USING (doc_id)"""
