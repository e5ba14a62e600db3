"""One-object files read by ranges."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.session import shared_dir
from lodestone.sources import objects
from lodestone.sources.envelope import read_envelopes, write_envelope
from lodestone.sources.layers import read_project
from lodestone.sources.objects import read_items

TEXTS = ["", 'a"b', "\\", 'x\\"y}', "},{", "[1]", "é😀", '\\\\"', '{"a":[']


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 5:
        return {rng.choice("abc") + rng.choice(["", '"', "\\"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.random(), rng.choice(TEXTS), -3, 0, 0, "q" * rng.randrange(30)][kind]


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        for name, setting in zip(names, (size, 0), strict=True):
            spark.conf.set(name, str(setting))

    yield of
    for name, setting in before.items():
        spark.conf.set(name, setting)


@pytest.mark.parametrize("size", [37, 200, 1 << 20])
def test_items_of_any_objects(spark, ranges, tmp_path, size):
    rng, expected = random.Random(2), []
    for n in range(12):
        keys = rng.sample(["documents", 'm"x', "other", "ключ", "z z"], rng.randrange(6))
        whole = {k: [value(rng) for _ in range(rng.randrange(12))] if rng.random() < 0.7 else value(rng) for k in keys}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + rng.choice(["", "\n"])
        (tmp_path / f"{n}.json").write_text(text)
        expected += [(n, k, json.dumps(x)) for k, v in whole.items() if isinstance(v, list) for x in v]
    ranges(size)
    found = read_items(spark, f"{tmp_path}/*.json").collect()
    assert sorted((int(os.path.basename(r.file)[:-5]), r.key, json.dumps(json.loads(r.item))) for r in found) == sorted(expected)


def test_a_large_envelope_is_read_by_many_tasks(spark, ranges):
    """One file, no row of it whole, and more than one task with items."""
    folder = shared_dir(spark, "envelope")
    documents = spark.range(20_000).select(
        F.col("id").cast("string").alias("_id"), F.struct(F.concat(F.lit('te}x"t '), "id").alias("t"), F.array("id").alias("v")).alias("_source")
    )
    write_envelope(documents, "big", folder)
    ranges(64 << 10)
    path = f"{folder}/big_export.json"
    lines = objects._lines(spark, path).withColumn("part", F.spark_partition_id())
    parts = lines.groupBy("part").agg(F.max(F.length("value")).alias("longest"))
    assert parts.count() > 10 and parts.agg(F.max("longest")).first()[0] < 200
    read = read_envelopes(spark, path, documents.schema["_source"].dataType)
    assert sorted(map(str, read.drop("table").collect())) == sorted(map(str, documents.collect()))
    whole = json.loads(spark.read.text(path, wholetext=True).first()[0])
    assert (whole["index_name"], whole["total_documents"], len(whole["documents"])) == ("big", 20_000, 20_000)


def test_envelopes_without_documents(spark, tmp_path):
    for name, text in {"a": '{"documents": []}', "b": "{}", "c": '{"documents": [{"_id": "1", "_source": {"x": [1, "]"]}}, {"_id": null}]}'}.items():
        (tmp_path / f"{name}_export.json").write_text(text)
    rows = read_envelopes(spark, f"{tmp_path}/*_export.json", keep_empty=True).collect()
    assert sorted(map(tuple, rows), key=str) == [("a", None, None), ("b", None, None), ("c", "1", '{"x":[1,"]"]}'), ("c", None, None)]


def test_layers_of_a_project(spark, ranges, tmp_path):
    project = {"wells": [{"id": i, "geometry_wkt": f"POINT ({i} 1)", "attributes": {"k": "}" * i}} for i in range(50)], "empty": [], "lines": [{"id": 7}]}
    (tmp_path / "p.json").write_text(json.dumps(project, indent=1))
    ranges(100)
    found = {(r.layer, r.id, r.geometry_wkt, (r.attributes or {}).get("k")) for r in read_project(spark, f"{tmp_path}/p.json").collect()}
    assert found == {("wells", i, f"POINT ({i} 1)", "}" * i) for i in range(50)} | {("lines", 7, None, None)}
