"""Tables that are replaced whole."""

import pytest
from pyspark.sql import functions as F

from lodestone.session import shared_dir
from lodestone.sources.envelope import rebuild_catalog, replace_documents
from lodestone.sources.staged import StagedTable


def documents(spark, n, mark):
    return spark.range(n).select(F.col("id").cast("string").alias("_id"), F.struct(F.lit(mark).alias("mark"), F.array(F.lit(1.0)).alias("embedding")).alias("_source"))


def marks(table):
    return sorted({r.mark for r in table.read().collect()})


def test_the_newest_whole_version_is_read(spark):
    table = StagedTable(spark, shared_dir(spark, "staged"))
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    for n, mark in enumerate("abcd", 1):
        before = table.read() if n > 1 else None
        load = replace_documents(documents(spark, 10 * n, mark), table)
        assert (load.done, load.imported, load.complete) == (True, 10 * n, True) and marks(table) == [mark]
        # Who has the version before open can still read it.
        assert before is None or before.count() == 10 * (n - 1)
    assert len(table._names("versions")) == 2 and table.manifests() == [3, 4]


def test_a_load_that_is_killed_half_way_leaves_the_old_table(spark):
    table = StagedTable(spark, shared_dir(spark, "staged"))
    replace_documents(documents(spark, 20, "old"), table)
    broken = documents(spark, 1000, "new").repartition(8).withColumn(
        "_id", F.when(F.col("_id") == "777", F.raise_error(F.lit("the executor is lost")).cast("string")).otherwise(F.col("_id"))
    )
    with pytest.raises(Exception, match="the executor is lost"):
        replace_documents(broken, table)
    assert marks(table) == ["old"] and table.read().count() == 20
    # Written, but killed before the commit.
    version, folder = table.stage()
    documents(spark, 5, "half").write.parquet(folder)
    assert marks(table) == ["old"]
    assert replace_documents(documents(spark, 30, "new"), table).complete and marks(table) == ["new"]
    assert version not in table._names("versions")


def test_documents_that_cannot_be_stored_and_two_commits_at_once(spark):
    table = StagedTable(spark, shared_dir(spark, "staged"))
    some = documents(spark, 5, "a").withColumn("_id", F.when(F.col("_id") != "3", F.col("_id")))
    load = replace_documents(some, table)
    assert (load.imported, load.failed, load.complete) == (4, 1, True) and table.manifest()["rows"] == 4
    other = StagedTable(spark, table.path)
    other.manifests = lambda: []
    with pytest.raises(RuntimeError, match="another commit"):
        other.commit("x", 0)


def test_a_catalog_without_vectors_is_refused(spark):
    path = shared_dir(spark, "catalog")
    assert rebuild_catalog(documents(spark, 3, "a"), path).complete
    with pytest.raises(ValueError, match="no vector"):
        rebuild_catalog(documents(spark, 3, "b").withColumn("_source", F.struct(F.lit("b").alias("mark"))), path)
    assert marks(StagedTable(spark, path)) == ["a"]
