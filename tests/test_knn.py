import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import knn
from lodestone.operators.knn import build_cells, knn_by_cells, knn_topk
from lodestone.operators.profile import vector_health


def brute(queries, corpus, k, metric):
    found = set()
    for qid, q in queries:
        scored = []
        for cid, c in corpus:
            q_, c_ = np.array(q), np.array(c)
            if metric == "cosine":
                length = np.linalg.norm(q_) * np.linalg.norm(c_)
                if length == 0:
                    continue
                score = q_ @ c_ / length
            elif metric == "l2":
                score = -np.linalg.norm(q_ - c_)
            else:
                score = q_ @ c_
            scored.append((-round(score, 12), cid))
        found |= {(qid, cid, rank + 1) for rank, (_, cid) in enumerate(sorted(scored)[:k])}
    return found


def result(df):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of the corpus is one vector over and over; one vector is zero."""
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 6)).round(3)
    points[::3] = points[0]
    points[7] = 0
    corpus = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    queries = [(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(40, 6)))]
    queries[3] = (3, corpus[0][1])
    frames = (
        spark.createDataFrame(queries, "query_id int, embedding array<float>").select(
            "query_id", F.col("embedding").cast("array<double>").alias("embedding")
        ),
        spark.createDataFrame(corpus, "vec_id int, embedding array<double>").repartition(3),
    )
    return [(q["query_id"], q["embedding"]) for q in frames[0].collect()], corpus, *frames


@pytest.mark.parametrize("metric", V.METRICS)
def test_exact(vectors, metric):
    queries, corpus, q, c = vectors
    assert result(knn_topk(q, c, 5, metric)) == brute(queries, corpus, 5, metric)


@pytest.mark.parametrize("metric", V.METRICS)
def test_exact_by_cells(vectors, metric):
    """Blocks of 16 rows split the full cell and its queries; nothing is lost."""
    queries, corpus, q, c = vectors
    found = knn_by_cells(q, c, 5, metric, probes=7, n_cells=7, block_rows=16)
    assert result(found) == brute(queries, corpus, 5, metric)


def test_more_neighbours_than_rows(vectors):
    queries, corpus, q, c = vectors
    assert result(knn_topk(q, c, 500)) == brute(queries, corpus, 500, "cosine")
    assert result(knn_by_cells(q, c, 500, probes=4, n_cells=4)) == brute(queries, corpus, 500, "cosine")


def test_many_small_batches(spark, vectors):
    queries, corpus, q, c = vectors
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert result(knn_topk(q, c, 5, "l2")) == brute(queries, corpus, 5, "l2")
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("metric", V.METRICS)
def test_rounds_find_the_same(vectors, metric):
    queries, corpus, q, c = vectors
    whole = knn_topk(q, c, 5, metric).collect()
    assert sorted(knn_topk(q, c, 5, metric, max_queries=10).collect()) == sorted(whole)
    assert sorted(knn_topk(q, c, 5, metric, max_broadcast_bytes=100).collect()) == sorted(whole)


@pytest.mark.parametrize("max_queries", [2, 8192])
def test_empty_corpus_and_missing_ids(spark, vectors, max_queries):
    _, corpus, q, c = vectors
    assert knn_topk(q, c.limit(0), 5, max_queries=max_queries).collect() == []
    assert knn_by_cells(q, c.limit(0), 5).collect() == []
    named = c.select(F.when(F.col("vec_id") > 5, F.format_string("v%03d", "vec_id")).alias("vec_id"), "embedding")
    assert all(r.vec_id for r in knn_topk(q, named, 400, max_queries=max_queries).collect())
    with pytest.raises(ValueError, match="ids"):
        knn_topk(q, c.withColumn("vec_id", F.col("vec_id").cast("double")), 3)


@pytest.mark.parametrize("metric, scale, offset", [("inner", 1e-6, 0), ("l2", 1e-10, 0), ("l2", 1, 1e8), ("cosine", 1e-9, 0), ("inner", 1e6, 0)])
def test_ranking_is_exact_at_every_scale(spark, metric, scale, offset):
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(400, 5)) * scale + offset).tolist()
    c = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "vec_id int, embedding array<double>").repartition(3)
    q = c.where("vec_id < 50").withColumnRenamed("vec_id", "query_id")
    x = np.array(points)

    def scores(a):
        if metric == "l2":
            return -np.sqrt(np.square(x - a).sum(axis=1))
        unit = lambda v: v / np.sqrt((v * v).sum(axis=-1, keepdims=True))
        return (unit(x) * unit(a)).sum(axis=1) if metric == "cosine" else (x * a).sum(axis=1)

    wanted = {(i, int(j), n) for i in range(50) for n, j in enumerate(np.lexsort((np.arange(400), -scores(x[i])))[:10], 1)}
    assert result(knn_topk(q, c, 10, metric)) == wanted
    assert result(knn_by_cells(q, c, 10, metric, probes=99, n_cells=6, block_rows=50)) == wanted


def test_memory_does_not_grow_with_the_query_set(spark):
    """20,000 vectors of 64 as queries and corpus, in rounds."""
    c = spark.range(20_000).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.xxhash64("id", i).cast("double"))).alias("embedding")
    )
    q = c.withColumnRenamed("vec_id", "query_id")
    found = knn_topk(q, c, 1).agg(F.count("*"), F.count_if(F.col("query_id") == F.col("vec_id"))).first()
    assert tuple(found) == (20_000, 20_000)


def test_scale_of_the_query_does_not_matter(vectors):
    _, _, q, c = vectors
    scaled = q.withColumn("embedding", F.transform("embedding", lambda x: x * 7))
    assert result(knn_topk(scaled, c, 5)) == result(knn_topk(q, c, 5))


def test_all_cells_are_exact_and_few_are_close(vectors):
    queries, corpus, q, c = vectors
    cells = build_cells(c, n_cells=8)
    assert int(cells.sizes.sum()) == 299  # without the zero vector
    assert result(knn_by_cells(q, cells, 5, probes=8)) == brute(queries, corpus, 5, "cosine")
    near = {r[:2] for r in result(knn_by_cells(q, cells, 5, probes=4))}
    exact = {r[:2] for r in brute(queries, corpus, 5, "cosine")}
    assert len(near & exact) / len(exact) > 0.6


def test_text_ids_and_empty_queries(spark, vectors):
    _, corpus, q, c = vectors
    named = c.withColumn("vec_id", F.format_string("v%03d", "vec_id"))
    found = result(knn_topk(q, named, 3))
    assert {(a, int(b[1:]), r) for a, b, r in found} == result(knn_topk(q, c, 3))
    assert knn_topk(q.limit(0), c, 3).collect() == []


def test_wrong_size_is_an_error(vectors):
    _, _, q, c = vectors
    short = q.withColumn("embedding", F.slice("embedding", 1, 4))
    with pytest.raises(Exception, match="dimensions"):
        knn_topk(short, c, 3).collect()
    with pytest.raises(ValueError, match="metric"):
        knn_topk(q, c, 3, "angle")


def test_row_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    found = row.select(V.dot(a, b), V.norm(a), V.cosine(a, b), V.l2(a, b), V.cosine(a, z), V.unit(z), V.unit(a)).head()
    assert [round(x, 6) if isinstance(x, float) else x for x in found] == [
        24.0, 5.0, 0.96, 1.414214, None, [0.0, 0.0], [0.6, 0.8],
    ]
    assert V.metric_of("cosinesimil") == "cosine" and V.metric_of(None) == "l2"


def test_health(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [1.0])]
    health = vector_health(spark.createDataFrame(rows, "id int, embedding array<double>")).head()
    counted = {k: health[k] for k in ("total", "missing", "empty", "zero", "min_size", "max_size", "ragged")}
    assert counted == {
        "total": 5, "missing": 1, "empty": 1, "zero": 1, "min_size": 0, "max_size": 2, "ragged": True,
    }


@pytest.fixture
def dealt(monkeypatch):
    """Rows of either side that every cogrouping shuffles."""
    seen, paired = [], knn._paired

    def counted(left, right, keys, groups):
        seen.append((left.count(), right.count()))
        return paired(left, right, keys, groups)

    monkeypatch.setattr(knn, "_paired", counted)
    return seen


def test_what_is_shuffled_does_not_grow_with_rounds(dealt, vectors):
    """Rounds of one query are scored one by one, but the corpus is not shuffled once for each."""
    queries, corpus, q, c = vectors
    assert result(knn_topk(q, c, 5, max_queries=1)) == brute(queries, corpus, 5, "cosine")
    assert dealt == [(40, 299)]


def test_a_query_is_shuffled_once_for_each_block_not_each_cell(dealt, vectors):
    queries, corpus, q, c = vectors
    assert result(knn_by_cells(q, c, 5, probes=8, n_cells=8)) == brute(queries, corpus, 5, "cosine")
    assert dealt == [(40, 299)]
    knn_by_cells(q, c, 5, probes=8, n_cells=8, block_rows=150)
    assert dealt[1][1] == 299 and dealt[1][0] <= 40 * 3


@pytest.mark.parametrize("scale", [1.0, 1e160])
def test_slices_of_the_corpus_find_what_the_whole_does(scale):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(30, 5)).round(1), rng.normal(size=(2 * knn.SCORED_ROWS + 7, 5)).round(1) * scale
    ids = rng.permutation(len(c))
    for metric in ("inner", "l2") if scale == 1.0 else ("inner",):
        (found,) = knn._nearest(q, c, ids, 7, metric)
        scores = -np.sqrt(np.square(q[:, None] - c).sum(axis=2)) if metric == "l2" else (q[:, None] * c).sum(axis=2)
        wanted = [ids[np.lexsort((ids, -s))[:7]].tolist() for s in scores]
        assert [found[1][found[0] == i].tolist() for i in range(30)] == wanted


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("case", ["plain", "copies", "tiny", "far off", "of any length"])
def test_single_precision_leaves_out_nothing(case, metric):
    """Blocks of more rows than are scored at a time, against exact scores of all pairs; ids repeat."""
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(60, 7)), rng.normal(size=(knn.SCORED_ROWS + 900, 7))
    if case == "copies":
        c[::3], c[1::5], q[:20] = c[0], c[1], c[:20]
    elif case == "tiny":
        q, c = q * 1e-12, c * 1e-30
    elif case == "far off":
        q, c = q + 1e4, c + 1e4
    elif case == "of any length":
        q, c = q * 10.0 ** rng.integers(-30, 14, size=(60, 1)), c * 10.0 ** rng.integers(-30, 12, size=(len(c), 1))
    q, c = knn._prepared(q, metric), knn._prepared(c, metric)
    ids = rng.integers(0, 2000, size=len(c))
    rows, found, score = (np.concatenate(column) for column in zip(*knn._nearest(q, c, ids, 7, metric), strict=True))
    for i in range(len(q)):
        exact = -np.sqrt(np.square(q[i] - c).sum(axis=1)) if metric == "l2" else (q[i] * c).sum(axis=1)
        best = np.lexsort((ids, -exact))[:7]
        assert found[rows == i].tolist() == ids[best].tolist() and score[rows == i].tolist() == exact[best].tolist()


def test_floats_are_shuffled_as_they_are(spark, monkeypatch, vectors):
    """Vectors of floats are not made doubles before they are copied to the blocks."""
    seen, paired = [], knn._paired
    monkeypatch.setattr(knn, "_paired", lambda left, right, *rest: (seen.extend((left, right)), paired(left, right, *rest))[1])
    q, c = (df.withColumn("embedding", F.col("embedding").cast("array<float>")) for df in vectors[2:])
    whole = result(knn_topk(q, c, 5))
    assert result(knn_topk(q, c, 5, max_queries=1)) == result(knn_by_cells(q, c, 5, probes=8, n_cells=8)) == whole
    assert [side.schema["_vec"].dataType.elementType.typeName() for side in seen] == ["float"] * 4


def test_report_measures_one_search_at_a_time(spark, tmp_path):
    """Shuffle files of the searches are gone when the report is there; k-means leaves some of its own."""
    from lodestone.queries import QUERIES

    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(np.random.default_rng(2).normal(size=(40, 4)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = known.size()
    report = QUERIES["knn_recall_report"](spark, str(tmp_path))
    assert known.size() <= before + 8
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()
    assert [r.recall for r in report.collect() if r.probes >= 3] == [1.0] * 6
