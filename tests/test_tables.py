import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from lodestone.operators.combine import tagged_union
from lodestone.operators.profile import (
    column_profile, profile_text, require_columns, require_rows, text_column, vector_column,
)
from lodestone.operators.reconcile import key_differences, load_summary, remaining
from lodestone.plans.catalog import attach_vectors, build_catalog, catalog_documents, catalog_prompts, embed, with_descriptions
from lodestone.session import shared_dir
from lodestone.sources import envelope as E, layers as L, mapping as M, records as R


def test_fields_by_type():
    assert (vector_column(T.StructType()), text_column(T.StructType())) == ("embedding", "text")
    text = T.StringType()
    schema = T.StructType().add("n", T.IntegerType()).add("vector", text).add("title", text)
    assert (vector_column(schema), text_column(schema)) == ("vector", "vector")
    schema = schema.add("emb", T.ArrayType(T.FloatType()))
    assert vector_column(schema) == "emb"


def test_profile(spark):
    rows = spark.createDataFrame([(1, None, float("nan")), (2, "x", 1.0)], "a int, `b, %` string, c double")
    profile = column_profile(rows)
    assert [tuple(r)[1:] for r in profile.orderBy("position").collect()] == [
        ("a", "int", 2, 2), ("b, %", "string", 1, 2), ("c", "double", 1, 2),
    ]
    lines = profile_text(profile).head()[0].split("\n")
    assert lines[1] == "- `b, %` (string, заполнено: 1/2)"


def test_requirements(spark):
    rows = spark.range(1).withColumn("text", F.lit("x"))
    with pytest.raises(ValueError, match="embedding"):
        require_columns(rows)
    with pytest.raises(ValueError, match="no rows"):
        require_rows(rows.where("false"))


def test_tagged_union_by_the_case_rule(spark):
    a = spark.createDataFrame([(1,)], "X int")
    b = spark.createDataFrame([("t",)], "x string")
    twice = spark.createDataFrame([(2, 3)], "x int, y int").toDF("x", "X")
    rows = tagged_union({"a": a, "b": b, "c": twice})
    assert rows.columns == ["X", "X_2", "matched_feature"]
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", None, "a"), ("2", 3, "c"), ("t", None, "b")]


def test_tagged_union(spark):
    a = spark.createDataFrame([(1, [1.5])], "x int, y array<double>")
    b = spark.createDataFrame([("word", 2.5)], "x string, z double")
    c = spark.createDataFrame([(3,)], "z bigint")
    rows = tagged_union({"a": a, "b": b, "c": c})
    assert rows.schema["x"].dataType == T.StringType() and rows.schema["z"].dataType == T.DoubleType()
    assert sorted(map(tuple, rows.select("matched_feature", "x", "y", "z").collect())) == [
        ("a", "1", [1.5], None), ("b", "word", None, 2.5), ("c", None, None, 3.0),
    ]


def test_reconcile_with_copies(spark):
    expected = spark.createDataFrame([("a",)] * 50 + [("b",), ("c",)], "_id string")
    stored = spark.createDataFrame([("a",)] * 48 + [("b",), ("d",)], "_id string")
    assert sorted(map(tuple, key_differences(expected, stored).collect())) == [("a", 50, 48), ("c", 1, 0), ("d", 0, 1)]
    row = load_summary(expected, stored).head()
    assert (row["missing_rows"], row["surplus_rows"], row["complete"], row["critical"]) == (3, 1, False, False)
    assert load_summary(expected, stored.where("false")).head()["critical"]
    assert sorted(r["_id"] for r in remaining(expected, stored, ["_id"]).collect()) == ["c"]


DOCUMENTS = [
    {"_id": "0", "_source": {"text": "т", "embedding": [1.0, 2.0]}},
    {"_id": "1", "_source": {"text": "u", "embedding": [3.0, 4.0]}},
    {"_id": None, "_source": {"text": "bad"}},
]


@pytest.fixture
def folder(tmp_path):
    for name, documents in (("first", DOCUMENTS), ("second", DOCUMENTS[:1])):
        body = {"index_name": name, "mappings": M.mapping_of(SOURCE), "documents": documents, "total_documents": 1}
        with open(tmp_path / f"{name}_export.json", "w", encoding="utf-8") as f:
            json.dump(body, f, ensure_ascii=False, indent=2)
    with open(tmp_path / "empty_export.json", "w") as f:
        f.write("{}")
    return str(tmp_path)


SOURCE = T.StructType().add("text", T.StringType()).add("embedding", T.ArrayType(T.DoubleType()))


def test_one_object_envelopes(spark, folder):
    rows = E.read_envelopes(spark, f"{folder}/*_export.json", SOURCE)
    assert sorted((r["table"], r["_id"] or "") for r in rows.collect()) == [
        ("first", ""), ("first", "0"), ("first", "1"), ("second", "0"),
    ]
    summary = E.import_directory(spark, folder, f"{folder}/stored")
    wanted = [("empty", 0, 0, True), ("first", 2, 1, False), ("second", 1, 0, False)]
    assert sorted(map(tuple, summary.collect())) == wanted
    with pytest.raises(FileExistsError):
        E.import_directory(spark, folder, f"{folder}/stored")
    # Loading one table again leaves the others.
    os.makedirs(f"{folder}/again")
    os.rename(f"{folder}/second_export.json", f"{folder}/again/second_export.json")
    again = E.import_directory(spark, f"{folder}/again", f"{folder}/stored", overwrite=True)
    assert list(map(tuple, again.collect())) == [("second", 1, 0, False)]
    stored = spark.read.parquet(f"{folder}/stored").where("valid").groupBy("table").count()
    assert sorted(map(tuple, stored.collect())) == [("first", 2), ("second", 1)]


def test_import_refuses_and_overwrites(spark, folder):
    documents = E.read_envelopes(spark, f"{folder}/first_export.json", SOURCE).drop("table")
    target = f"{folder}/table"
    load = E.import_documents(documents, target)
    assert (load.done, load.imported, load.failed, load.complete, load.critical) == (True, 2, 1, True, False)
    assert not E.import_documents(documents, target).done
    assert E.import_documents(documents, target, "overwrite").done
    assert E.rebuild_catalog(documents, target).imported == 2
    with pytest.raises(ValueError, match="vector"):
        E.rebuild_catalog(documents.select("_id", F.struct("_source.text").alias("_source")), target)


def test_export_and_import(spark, tmp_path):
    rows = spark.createDataFrame([("0", "a", [1.0], {"k": "v"}), ("1", None, None, None)],
                                 "_id string, `Rо,%` string, v array<double>, m map<string,string>")
    assert E.export_table(rows, "t", str(tmp_path), {"knn": True})
    assert not E.export_table(None, "none", str(tmp_path))
    manifest = E.read_manifest(spark, "t", str(tmp_path))
    assert manifest["total_documents"] == 2 and manifest["mappings"]["properties"]["v"]["type"] == "knn_vector"
    load = E.import_table(spark, "t", str(tmp_path), str(tmp_path / "loaded"))
    assert load.complete
    back = spark.read.parquet(str(tmp_path / "loaded"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(back.columns).collect()))
    assert not E.import_table(spark, "missing", str(tmp_path), str(tmp_path / "x")).done


def test_feature_table(spark, folder):
    text = '{"properties":{"a":{"type":"text","fields":{"keyword":{"type":"keyword"}}},"b":{},"c":{"type":"long"}}}'
    rows = M.feature_table(spark.createDataFrame([(text,)], "mappings string"))
    assert sorted(r[:2] for r in map(tuple, rows.collect())) == [
        ("a", "text (keyword)"), ("b", "unknown"), ("c", "long"),
    ]
    assert [r["feature_name"] for r in M.list_fields(rows).collect()] == ["a", "b", "c"]
    found = M.feature_table(M.read_mappings(spark, f"{folder}/*_export.json"), "mappings", "index_name")
    vector = found.where("index_name = 'first' AND feature_name = 'embedding'").head()
    assert (vector["feature_type"], vector["dimension"], vector["space_type"]) == ("knn_vector", 1024, "cosinesimil")


def test_fields_by_mapping():
    mapping = M.mapping_of(T.StructType().add("title", T.StringType()).add("v", T.ArrayType(T.FloatType())))
    assert (M.vector_field(mapping), M.text_field(mapping), M.metric_of_mapping(mapping)) == ("v", "title", "cosine")
    bare = {"properties": {"vector": {"type": "float"}}}
    assert (M.vector_field(bare), M.text_field(bare), M.metric_of_mapping(bare)) == ("vector", "text", "l2")
    assert M.vector_field({}) == "embedding"


def test_no_records(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    rows = R.read_records(spark, str(tmp_path / "none"))
    assert rows.columns == ["_id"] and rows.count() == 0


def test_records(spark, tmp_path):
    path = str(tmp_path / "records")
    os.makedirs(path)
    with open(f"{path}/a.json", "w", encoding="utf-8") as f:
        f.write('{"_id": "1", "lon": "[1, 2]", "Rо,%": 1.5}\n{"_id": "2", "Свита": "X"}\n')
    schema = R.infer_schema(spark, path, f"{tmp_path}/schema")
    assert R.load_schema(spark, f"{tmp_path}/schema") == schema
    rows = R.read_records(spark, path, schema)
    assert set(rows.columns) == {"_id", "lon", "Rо,%", "Свита"} and rows.count() == 2
    shown = R.preview(rows, 1, F.col("_id")).collect()
    assert [r["total"] for r in shown] == [2] and json.loads(shown[0]["document"])["_id"] == "1"


def test_layers(spark, tmp_path):
    feature = {"id": 1, "geometry_wkt": "POINT (1 2)", "geometry_type": 0, "attributes": {"n": 5, "s": "x", "z": None}}
    bare = {"id": 2, "geometry_wkt": None, "geometry_type": None, "attributes": {"n": 1.5}}
    with open(tmp_path / "layer.json", "w") as f:
        json.dump([feature, bare], f, indent=4)
    with open(tmp_path / "project.json", "w") as f:
        json.dump({"coast": [feature], "wells": [bare, feature]}, f, indent=4)
    layer = L.read_features(spark, str(tmp_path / "layer.json"), lines=False)
    assert sorted(map(tuple, L.layer_profile(layer).collect()), key=str) == [(0, 1, 1), (None, 1, 0)]
    kinds = {r["attribute"]: (r["filled"], r["value_type"]) for r in L.attribute_profile(layer).collect()}
    assert kinds == {"n": (2, "real"), "s": (1, "string"), "z": (0, None)}
    project = L.read_project(spark, str(tmp_path / "project.json"))
    assert sorted((r["layer"], r["id"]) for r in project.collect()) == [("coast", 1), ("wells", 1), ("wells", 2)]
    assert L.attributes_long(project, "layer").count() == 7


def test_catalog(spark):
    features = spark.createDataFrame([("b", "text"), ("a", "long"), ("c", "long")], "feature_name string, feature_type string")
    prompt = catalog_prompts(features).where("feature_name = 'b'").head()["prompt"]
    assert "Название: b" in prompt and "Тип: text" in prompt
    responses = spark.createDataFrame(
        [("a", 1, None, "timeout"), ("a", 2, " описание ", None), ("b", 1, None, "e1"), ("b", 3, None, "e3"), ("c", 4, "late", None)],
        "feature_name string, attempt int, text string, error string",
    )
    described = with_descriptions(features, responses)
    texts = {r["feature_name"]: r["description"] for r in described.collect()}
    assert texts == {"a": "описание", "b": "Ошибка генерации: e3", "c": "Ошибка генерации: "}
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "feature_name string, embedding array<float>")
    assert [r["n"] for r in attach_vectors(features, vectors, "feature_name").orderBy("feature_name")
            .select(F.size("embedding").alias("n")).collect()] == [2, 0, 0]
    documents = catalog_documents(described, vectors).orderBy("_id").collect()
    assert [(d["_id"], d["feature_name"], d["failed"]) for d in documents] == [("0", "a", False), ("1", "b", True), ("2", "c", True)]
    assert documents[0]["_source"]["text"] == "Признак: a\nОписание: описание"
    path = shared_dir(spark, "catalog")
    assert build_catalog(features, responses, vectors, path).imported == 1
    done = spark.createDataFrame([("a",)], "feature_name string")
    assert build_catalog(features, responses, vectors, path, done).imported == 0
    assert spark.read.parquet(path).count() == 1


def test_resumed_catalog_is_the_whole_catalog(spark):
    name = F.format_string("f%02d", "id").alias("feature_name")
    features = spark.range(40).select(name, F.lit("long").alias("feature_type"))
    responses = features.select("feature_name").withColumns(
        {"attempt": F.lit(1), "text": F.lit("d"), "error": F.lit(None).cast("string")}
    )
    vectors = features.select("feature_name", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    path, whole = (shared_dir(spark, "catalog") for _ in range(2))
    begun = features.where("feature_name < 'f17'").select("feature_name")
    build_catalog(features, responses, vectors, whole)
    late = responses.where("feature_name < 'f17'")
    assert build_catalog(features, late, vectors, path).imported == 17
    load = build_catalog(features, responses, vectors, path, begun)
    assert (load.imported, load.complete) == (23, True)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, spark.read.parquet(whole).collect()))


def test_embed_hook(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    sizes = embed(rows, "t", lambda texts: [[float(len(x))] for x in texts]).collect()
    assert sorted(r["embedding"] for r in sizes) == [[0.0], [2.0]]

    def broken(texts):
        raise RuntimeError

    assert [r["embedding"] for r in embed(rows, "t", broken).collect()] == [[], []]

    def picky(texts):
        if "" in texts:
            raise ValueError("nothing to embed")
        return [[float(len(x))] for x in texts]

    more = rows.unionByName(spark.createDataFrame([("x" * i,) for i in range(1, 6)], "t string")).coalesce(1)
    assert sorted(r["embedding"] for r in embed(more, "t", picky).collect()) == [[], [1.0], [2.0], [2.0], [3.0], [4.0], [5.0]]


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("n", "t", "d")], "feature_name string, feature_type string, description string")
    E.write_catalog_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["Название признака", "Тип данных", "Описание"] and tuple(back.head()) == ("n", "t", "d")


def test_project_files_stay_bounded(spark, data, monkeypatch):
    """A file, which is one row, does not grow with the events."""
    from lodestone.queries import QUERIES, roundtrips

    monkeypatch.setattr(roundtrips, "FILE_FEATURES", 20, raising=False)
    sizes = []
    read = roundtrips.read_project
    count = F.length("value") - F.length(F.replace("value", F.lit('"id":'), F.lit('"id"')))

    def measured(session, path):
        sizes.extend(r[0] for r in session.read.text(path, wholetext=True).select(count).collect())
        return read(session, path)

    monkeypatch.setattr(roundtrips, "read_project", measured)
    rows = QUERIES["project_layers"](spark, data).count()
    assert rows == sum(sizes) == spark.read.parquet(f"{data}/events.parquet").count() and max(sizes) <= 50
