"""Search by product-quantised codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import knn, quantised
from lodestone.operators.knn import knn_topk
from lodestone.operators.quantised import build_index, encode, search, tables, train_books


def vectors(spark, n, width, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    x = centres[rng.integers(20, size=n)] + 0.4 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_tables_give_the_distance_to_what_a_code_stands_for():
    x = np.random.default_rng(2).normal(size=(300, 10))
    books = train_books(x, 4)
    codes, look = encode(x, books), tables(x[:5], books)
    padded = np.pad(x, ((0, 0), (0, 2)))
    stood_for = np.concatenate([books[p][codes[:, p]] for p in range(4)], axis=1)
    wanted = np.square(padded[:5, None] - stood_for[None]).sum(axis=2)
    found = np.stack([t[np.arange(4), codes].sum(axis=1) for t in look])
    assert np.allclose(found, wanted)
    # Every sub-space has the nearest centroid.
    assert (np.square(padded - stood_for).sum(axis=1) <= np.square(padded - stood_for[::-1]).sum(axis=1) + 1e-9).all()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_and_exact_scores(spark, metric):
    corpus = vectors(spark, 3000, 32)
    queries = corpus.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    index = build_index(corpus, metric, parts=8, n_cells=12)
    assert 10 * index.code_bytes < index.vector_bytes and index.codes.count() == 3000
    exact = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in knn_topk(queries, corpus, 10, metric).collect()}
    found = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in search(queries, index, 10, probes=6).collect()}
    both = exact.keys() & found.keys()
    assert len(both) >= 0.9 * len(exact) and len(found) == len(exact)
    assert all(abs(exact[p][0] - found[p][0]) < 1e-9 for p in both)
    # With every cell and candidate the search is exact.
    whole = {(r.query_id, r.vec_id): r["rank"] for r in search(queries, index, 10, probes=12, rerank=3000).collect()}
    assert whole == {p: rank for p, (_, rank) in exact.items()}


def test_few_vectors_and_none(spark):
    corpus = vectors(spark, 5, 6).unionByName(spark.createDataFrame([(9, None), (None, [1.0] * 6), (10, [0.0] * 6)], "vec_id long, embedding array<double>"))
    queries = corpus.withColumnRenamed("vec_id", "query_id")
    index = build_index(corpus, parts=4)
    found = search(queries, index, 10, probes=99)
    assert sorted(map(tuple, found.select("query_id", "vec_id", "rank").collect())) == sorted(
        map(tuple, knn_topk(queries, corpus, 10).select("query_id", "vec_id", "rank").collect())
    )
    empty = build_index(corpus.limit(0))
    assert search(queries, empty, 3).collect() == []
    with pytest.raises(ValueError, match="cosine or l2"):
        build_index(corpus, "inner")
    assert search(queries.where(F.lit(False)), index, 3).collect() == []


def test_candidates_and_vectors_are_not_copied_to_cells_or_pairs(spark, monkeypatch):
    """Each query goes once to the one block of codes and the one of vectors, and gives `rerank` candidates, though it visits 30 cells."""
    seen, paired = [], knn._paired

    def counted(left, right, keys, groups):
        seen.append((left.count(), right.count()))
        return paired(left, right, keys, groups)

    monkeypatch.setattr(knn, "_paired", counted)
    corpus = vectors(spark, 600, 8)
    queries = corpus.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = search(queries, build_index(corpus, n_cells=30, parts=4), 5, probes=30, rerank=600)
    # The codes are one block; the queries are cut into parts for the cores, and each part meets it.
    assert seen[0][0] == 30 and seen[0][1] <= 600 * knn.BLOCKS_A_CORE * spark.sparkContext.defaultParallelism
    assert seen[1] == (30, 600)
    wanted = knn_topk(queries, corpus, 5).select("query_id", "vec_id", "rank")
    assert sorted(map(tuple, found.select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, wanted.collect()))


def by_codes(books, queries, corpus, rerank):
    """The `rerank` candidates of each query id, all codes looked up; several rows of an id share them."""
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    codes = encode(unit(corpus[1]), books).T.astype(np.intp)
    found = {}
    for qid, look in zip(queries[0], tables(unit(queries[1]), books), strict=True):
        far = quantised._looked_up(look, codes)
        best = np.lexsort((corpus[0], far))[:rerank]
        found.setdefault(qid, []).extend(zip(far[best], corpus[0][best], strict=True))
    return {qid: [int(cid) for _, cid in sorted(some)[:rerank]] for qid, some in found.items()}


@pytest.mark.parametrize("code_bytes", [64 << 20, 40 * 2500])
@pytest.mark.parametrize("copies", [0, 3000])
def test_candidates_are_those_that_look_nearest(spark, monkeypatch, code_bytes, copies):
    """More codes than are scored at a time, ids and queries that repeat, and a vector that is half of the corpus; one block of codes and several."""
    monkeypatch.setattr(quantised, "CODE_BYTES", code_bytes)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 12)).astype(np.float32)
    x[rng.permutation(6000)[:copies]] = x[0]
    ids = np.r_[np.arange(5990), np.arange(10)]
    qids = np.r_[np.arange(38), 7, 8]
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(int(i), x[j].tolist()) for j, i in enumerate(qids)], "query_id long, embedding array<float>")
    index = build_index(corpus, parts=4, n_cells=9)
    paired = knn._paired
    # What is paired last are the lists; a view, as what stands in the module goes to the tasks.
    monkeypatch.setattr(knn, "_paired", lambda left, *rest: (left.createOrReplaceTempView("paired_last"), paired(left, *rest))[1])
    search(queries, index, 5, probes=9, rerank=40)
    rows, lists = spark.table("paired_last").collect(), {}
    for qid, _, cids in sorted({(r["_qid"], r["_c"], tuple(sorted(r["_cids"]))) for r in rows}):
        lists.setdefault(qid, []).extend(cids)
    wanted = by_codes(index.books, (qids, x[:40].astype(float)), (ids, x.astype(float)), 40)
    assert {q: sorted(c) for q, c in lists.items()} == {q: sorted(c) for q, c in wanted.items()}
    # Each row of an id has the list.
    assert sorted(r["_qid"] for r in rows) == sorted(np.repeat(qids, [len({r["_c"] for r in rows if r["_qid"] == q}) for q in qids]).tolist())
