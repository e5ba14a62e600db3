import corpus_pipeline
from lodestone.llm.common import Stored
from lodestone.llm.decontaminate import leaks
from lodestone.llm.queries import QUERIES
from lodestone.llm.simhash import simhash_components
from rows import frame


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, columns = docs, docs.columns
    (_, quality), (_, copies), (_, decontamination), (_, mixing), (_, shards) = corpus_pipeline.STAGES
    good = Stored(quality(spark, kept, data), "t").df
    accepted = [r.doc_id for r in QUERIES["op9_quality"](spark, data).collect() if r.predicted]
    assert good.columns == columns and ids(good) == sorted(accepted)
    single = Stored(copies(spark, good, data), "t").df
    assert single.columns == columns
    assert ids(single) == sorted({r.component_id for r in simhash_components(good).collect()})
    clean = Stored(decontamination(spark, single, data), "t").df
    leaked = {r.doc_id for r in leaks(single, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert clean.columns == columns and ids(clean) == sorted(set(ids(single)) - leaked)
    mixed = Stored(mixing(spark, clean, data), "t").df
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(clean))
    out = shards(spark, mixed, data).collect()
    assert sorted(r.doc_id for r in out) == ids(mixed)
    assert max(r.start + r.n_tokens for r in out) == sum(r.n_tokens for r in out)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect()) == sorted(tuple(r) for r in out)


def test_empty_documents(spark, data):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.collect() == []
