"""Export and import of a table with its mapping, and checks of the load.

An export is a folder: `documents` holds JSON lines `{_id, _source}` in as many files as there are tasks,
and `manifest` one line with the name, mapping, settings and row count. Envelopes that hold all documents in
one object are read too, each by as many tasks as it has ranges (`objects`).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from lodestone.functions import fixed
from lodestone.operators.profile import vector_column
from lodestone.sources.mapping import mapping_of
from lodestone.sources.objects import read_items
from lodestone.sources.staged import StagedTable

SUFFIX = "_export"
DOCUMENT = "_id string, _source string"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def export_table(
    df: DataFrame | None, name: str, directory: str, settings: Mapping | None = None, key: str = "_id"
) -> bool:
    """Write a table as an export folder; False if there is no table to write."""
    if df is None:
        return False
    spark = df.sparkSession
    target = f"{directory.rstrip('/')}/{name}{SUFFIX}"
    source = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    df.select(F.col(f"`{key}`").cast("string").alias("_id"), source.alias("_source")).write.mode(
        "overwrite"
    ).json(f"{target}/documents")
    stored = spark.read.schema(DOCUMENT).json(f"{target}/documents").count()
    body = df.drop(key).schema
    manifest = {
        "index_name": name,
        "mappings": mapping_of(body),
        "settings": dict(settings or {}),
        "schema": json.loads(body.json()),
        "total_documents": stored,
    }
    line = [(json.dumps(manifest, ensure_ascii=False),)]
    spark.createDataFrame(line, "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest")
    return True


def read_manifest(spark: SparkSession, name: str, directory: str) -> dict:
    path = f"{directory.rstrip('/')}/{name}{SUFFIX}/manifest"
    return json.loads(spark.read.text(path).head()[0])


def read_export(spark: SparkSession, name: str, directory: str) -> DataFrame:
    """Documents of an export folder as (`_id`, `_source` struct), with the schema it was written with."""
    schema = T.StructType.fromJson(read_manifest(spark, name, directory)["schema"])
    document = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_source", schema)])
    return spark.read.schema(document).json(f"{directory.rstrip('/')}/{name}{SUFFIX}/documents")


def read_envelopes(spark: SparkSession, path: str, source: T.StructType | None = None, keep_empty: bool = False) -> DataFrame:
    """Documents of one-object envelope files: (table, `_id`, `_source`).

    The table is the file name without its ending. Missing keys read as empty. `source` is the schema of
    `_source`; without it, `_source` stays JSON text. With `keep_empty` an envelope without documents is a row without id and source.
    """
    kind = source or T.StringType()
    document = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_source", kind)])
    name = F.regexp_extract("file", rf"([^/]+){SUFFIX}\.json$", 1).alias("table")
    items = read_items(spark, path).where(F.col("key") == "documents")
    held = items.select("file", F.from_json("item", document).alias("_d"))
    if keep_empty:
        files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
        held = files.join(held, "file", "left")
    return held.select(name, "_d.*")


def is_valid() -> Column:
    """Whether a document can be stored."""
    return F.col("_id").isNotNull() & (F.col("_id") != "") & F.col("_source").isNotNull()


def write_envelope(documents: DataFrame, name: str, directory: str) -> None:
    """Documents (`_id`, `_source`) as a one-object envelope file `name`_export.json, for readers that need that form.

    One file is written by one task, which takes the documents line by line; `export_table` has no such limit.
    """
    spark = documents.sparkSession
    target = f"{directory.rstrip('/')}/{name}{SUFFIX}"
    rows = documents.select(F.lit(1).alias("part"), F.to_json(F.struct("_id", "_source")).alias("value"))
    head = spark.range(1).select(F.lit(0), F.concat(F.lit('{"index_name":'), F.lit(json.dumps(name, ensure_ascii=False)), F.lit(',"documents":[')))
    total = documents.agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.lit(2), F.concat(F.lit('],"total_documents":'), "n", F.lit("}")))
    in_order = rows.union(head).union(total).repartition(1).sortWithinPartitions("part").withColumn("line", F.monotonically_increasing_id())
    # The head is line 0 of the one partition, so the first document is line 1, which needs no comma before it.
    comma = F.when((F.col("part") == 1) & (F.col("line") > 1), ",").otherwise("")
    in_order.select(F.concat(comma, "value").alias("value")).write.text(target)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(target)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    files.rename(part, hadoop.Path(f"{target}.json"))
    files.delete(folder, True)


def split_valid(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be stored, and those that lack an id or a source."""
    return documents.where(is_valid()), documents.where(~is_valid())


@dataclass
class Load:
    """Outcome of a load."""

    done: bool
    imported: int = 0
    failed: int = 0
    complete: bool = False
    critical: bool = False


def _ids(rows: DataFrame):
    """Count and sum of hashes of the ids: equal for the same ids in any order."""
    row = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_id").cast("decimal(38,0)"))).first()
    return row[0], row[1] or 0


def import_documents(documents: DataFrame, path: str, mode: str = "new") -> Load:
    """Store documents as Parquet.

    `mode` is `new`, which refuses a target that exists, `overwrite`, or `append`, which adds to what is stored. The source is
    read once: documents are counted while they are written, and the ids that the table has gained are compared with them.
    """
    if mode not in ("new", "overwrite", "append"):
        raise ValueError(f"mode: {mode}")
    spark = documents.sparkSession
    stored = path_exists(spark, path)
    if stored and mode == "new":
        return Load(done=False)
    before = _ids(spark.read.parquet(path)) if stored and mode == "append" else (0, 0)
    source = documents.schema["_source"].dataType
    columns = ["_id", "_source.*"] if isinstance(source, T.StructType) else ["_id", "_source"]
    good, bad, wanted = _write_valid(documents, columns, path, "append" if mode == "append" else "overwrite")
    rows, ids = _ids(spark.read.parquet(path))
    gained = rows - before[0]
    return Load(True, gained, bad, gained == good and ids - before[1] == wanted, gained == 0 and good + bad > 0)


def _write_valid(documents: DataFrame, columns: list[str], path: str, mode: str) -> tuple[int, int, int]:
    """Writes what can be stored; how much was and was not, and the sum of the ids' hashes."""
    # Valid documents are seen as they are written, the others as they are left out.
    seen = Observation()
    counted = documents.withColumn("_valid", is_valid()).observe(
        seen,
        F.count_if("_valid").alias("good"),
        F.count_if(~F.col("_valid")).alias("bad"),
        F.sum(F.when(F.col("_valid"), F.xxhash64("_id").cast("decimal(38,0)"))).alias("ids"),
    )
    counted.where("_valid").select(*columns).write.mode(mode).parquet(path)
    return seen.get["good"], seen.get["bad"], seen.get["ids"] or 0


def replace_documents(documents: DataFrame, table: StagedTable) -> Load:
    """Replace a table by documents: the new version is written and compared with what was read, and only a whole one is committed."""
    source = documents.schema["_source"].dataType
    version, folder = table.stage()
    good, bad, wanted = _write_valid(documents, ["_id", "_source.*"] if isinstance(source, T.StructType) else ["_id", "_source"], folder, "errorifexists")
    rows, ids = _ids(table.spark.read.parquet(folder))
    complete = rows == good and ids == wanted
    if complete:
        table.commit(version, rows)
    return Load(complete, rows, bad, complete, rows == 0 and good + bad > 0)


def import_table(spark: SparkSession, name: str, directory: str, target: str, mode: str = "new") -> Load:
    """Load an export folder; a missing export is skipped."""
    try:
        documents = read_export(spark, name, directory)
    except AnalysisException:
        return Load(done=False)
    return import_documents(documents, target, mode)


def import_directory(spark: SparkSession, directory: str, target: str, overwrite: bool = False) -> DataFrame:
    """Load every one-object envelope of a folder, one table per file; a summary row per table.

    The files are read and stored once, split by table; with `overwrite` the tables that the folder holds are replaced and all
    others stay. The summary counts the documents of each table; zero stored documents are critical.
    """
    documents = read_envelopes(spark, f"{directory.rstrip('/')}/*{SUFFIX}.json", keep_empty=True)
    if path_exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    empty = F.col("_id").isNull() & F.col("_source").isNull()
    flagged = documents.withColumn("valid", F.when(~empty, is_valid()))
    flagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table").parquet(target)
    names = documents.select("table").distinct()
    stored = spark.read.schema(flagged.schema).parquet(target).join(names, "table", "left_semi")
    return (
        stored.groupBy("table")
        .agg(F.count_if("valid").alias("imported"), F.count_if(~F.col("valid")).alias("failed"))
        .withColumn("critical", F.col("imported") == 0)
    )


def rebuild_catalog(documents: DataFrame, path: str) -> Load:
    """Replace a catalog table (`StagedTable`) after a check that its documents hold a vector field."""
    source = documents.schema["_source"].dataType
    field = vector_column(source)
    if field not in source.names or not isinstance(source[field].dataType, T.ArrayType):
        raise ValueError("the documents hold no vector field")
    return replace_documents(documents, StagedTable(documents.sparkSession, path))


def write_catalog_csv(features: DataFrame, path: str) -> None:
    """Catalog as CSV with three columns: name, type, description."""
    names = fixed.CATALOG_CSV_COLUMNS
    columns = [F.col(c).alias(n) for c, n in zip(("feature_name", "feature_type", "description"), names)]
    features.select(*columns).write.mode("overwrite").option("header", True).csv(path)
