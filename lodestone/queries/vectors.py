"""Vector search."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from lodestone.functions import fixed
from lodestone.functions.vectors import cosine, dot, l2, metric_of, norm, unit
from lodestone.operators.knn import build_cells, knn_by_cells, knn_topk
from lodestone.operators.profile import require_columns, vector_column, vector_health
from lodestone.operators.quantised import build_index, search as search_codes
from lodestone.queries.registry import Tables, query
from lodestone.session import kept, shuffles_cleaned
from lodestone.sources.records import metadata

K = fixed.TOP_K


def _pairs(measure: str, order: str) -> str:
    return f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, {measure} AS score FROM e q, e c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}"""


COSINE_SQL = _pairs("list_cosine_similarity(q.v, c.v)", "DESC")


def _as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label: one query per label, however many vectors there are."""
    mean = Summarizer.mean(array_to_vector("embedding"))
    return vectors.groupBy("label").agg(vector_to_array(mean).alias("embedding"))


CENTROID_SQL = f"""
    WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i),
    q AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
    s AS (SELECT q.label, e.vec_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS score FROM q, embeddings e),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT label, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}"""


@query(CENTROID_SQL)
def knn_centroid_topk(t: Tables) -> DataFrame:
    """Nearest vectors to the centre of each label: one scan of the corpus."""
    return _rounded(knn_topk(centroids(t.embeddings), t.embeddings, K, query_id="label"))


@query(COSINE_SQL)
def knn_cosine_topk(t: Tables) -> DataFrame:
    """Nearest vectors of every vector by cosine."""
    return _rounded(knn_topk(_as_queries(t.embeddings), t.embeddings, K, metric_of("cosinesimil")))


@query(_pairs("list_distance(q.v, c.v)", "ASC"))
def knn_l2_topk(t: Tables) -> DataFrame:
    """Nearest vectors by distance, the metric of a mapping that names none."""
    return _rounded(knn_topk(_as_queries(t.embeddings), t.embeddings, K, metric_of(None)))


@query(_pairs("list_inner_product(q.v, c.v)", "DESC"))
def knn_inner_topk(t: Tables) -> DataFrame:
    return _rounded(knn_topk(_as_queries(t.embeddings), t.embeddings, K, metric_of("innerproduct")))


@query(COSINE_SQL)
def knn_scaled_query(t: Tables) -> DataFrame:
    """Query vectors of another length find the same neighbours by cosine."""
    scaled = t.embeddings.select(
        F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding")
    )
    return _rounded(knn_topk(scaled, t.embeddings, K))


@query(COSINE_SQL)
def knn_cells_exact(t: Tables) -> DataFrame:
    """Exact search for query sets too large for one broadcast: rounds of 256 queries over the corpus."""
    return _rounded(knn_topk(_as_queries(t.embeddings), t.embeddings, K, max_queries=256))


def _small(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.select(F.col("vec_id").alias(name), F.transform("embedding", lambda x: x.cast("double") * 1e-6).alias("embedding"))


@query(f"""
    WITH e AS (SELECT vec_id, [x::DOUBLE * 1e-6::DOUBLE for x in embedding] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q, e c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score * 1e12, 4) AS score, rank FROM r WHERE rank <= {K}""")
def knn_small_vectors(t: Tables) -> DataFrame:
    """Vectors of a millionth the length are ranked as exactly as any."""
    found = knn_topk(_small(t.embeddings, "query_id"), _small(t.embeddings, "vec_id"), K, "inner")
    return found.withColumn("score", F.round(F.col("score") * 1e12, 4))


PROBES = (1, 4, 10_000)
RECALL_FLOOR = 0.3


@query(f"""
    WITH n AS (SELECT count(*) AS n FROM embeddings)
    SELECT unnest([1, 4, 10000])::INTEGER AS probes, unnest([false, false, true]) AS exact, true AS above_floor,
           least(n, {K}) * n AS compared FROM n""")
def knn_ann_recall(t: Tables) -> DataFrame:
    """Approximate search in a few cells against the exact one: all probes find all; the pairs that were compared."""
    queries = _as_queries(t.embeddings)
    exact = kept(knn_topk(queries, t.embeddings, K).select("query_id", "vec_id"), "exact")
    cells = build_cells(t.embeddings)
    parts = []
    for probes in PROBES:
        found = knn_by_cells(queries, cells, K, probes=probes).select("query_id", "vec_id", F.lit(1).alias("_found"))
        recall = exact.join(found, ["query_id", "vec_id"], "left").agg(
            F.count(F.lit(1)).alias("compared"), (F.count("_found") / F.count(F.lit(1))).alias("recall")
        )
        parts.append(
            recall.select(
                F.lit(probes).alias("probes"), (F.col("recall") == 1.0).alias("exact") if probes > 4 else F.lit(False).alias("exact"),
                (F.col("recall") >= (RECALL_FLOOR if probes >= 4 else 0.1)).alias("above_floor"), "compared",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """`compared` pairs of the exact result, and the share of them that was found."""
    marked = found.select("query_id", "vec_id", F.lit(1).alias("_found"))
    return exact.join(marked, ["query_id", "vec_id"], "left").agg(
        F.count(F.lit(1)).alias("compared"), (F.count("_found") / F.count(F.lit(1))).alias("recall")
    )


@query()
def knn_recall_report(t: Tables) -> DataFrame:
    """Measured recall of the approximate searches, by method and cells visited; a measurement, which SQL does not give.

    One search runs at a time, and its shuffle files go when it has ended, so the disk holds those of one search.
    """
    queries = _as_queries(t.embeddings)
    parts = []
    with shuffles_cleaned(t.embeddings.sparkSession):
        exact = kept(knn_topk(queries, t.embeddings, K).select("query_id", "vec_id"), "exact")
        index = build_index(t.embeddings)
        share = index.code_bytes / max(1, index.vector_bytes)
        for probes in (1, 4, 16, len(index.cells.centroids)):
            for method, search, corpus, size in (("cells", knn_by_cells, index.cells, 1.0), ("codes", search_codes, index, share)):
                recall = _recall(exact, search(queries, corpus, K, probes=probes))
                parts.append(kept(recall.select(F.lit(method).alias("method"), F.lit(probes).alias("probes"), "compared", "recall", F.lit(size).alias("index_share")), "recall"))
    return reduce(DataFrame.unionByName, parts)


@query(f"""
    SELECT count(*) * least({K}, (SELECT count(*) FROM embeddings)) AS compared, true AS recall_holds, true AS small_index FROM embeddings""")
def knn_codes_recall(t: Tables) -> DataFrame:
    """Search by codes of 16 bytes a vector: nine of ten neighbours are found, and the index is below a tenth of the vectors."""
    queries = _as_queries(t.embeddings)
    with shuffles_cleaned(t.embeddings.sparkSession):
        exact = kept(knn_topk(queries, t.embeddings, K).select("query_id", "vec_id"), "exact")
        index = build_index(t.embeddings)
    measured = _recall(exact, search_codes(queries, index, K, probes=len(index.cells.centroids)))
    return measured.select("compared", (F.col("recall") >= 0.9).alias("recall_holds"), F.lit(10 * index.code_bytes < index.vector_bytes).alias("small_index"))


@query(f"""
    WITH r AS ({COSINE_SQL})
    SELECT query_id, count(*) AS returned, max(score) AS max_score, (SELECT count(*) FROM embeddings) AS total
    FROM r GROUP BY query_id""")
def hit_stats(t: Tables) -> DataFrame:
    """Returned hits and best score per query, next to the size of the corpus."""
    hits = _rounded(knn_topk(_as_queries(t.embeddings), t.embeddings, K))
    stats = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.max("score").alias("max_score"))
    return stats.withColumn("total", t.embeddings.agg(F.count(F.lit(1))).scalar())


@query(f"""
    WITH r AS ({CENTROID_SQL})
    SELECT r.label, r.rank, r.score, d.doc_id, d.text,
           to_json(struct_pack(lang := d.lang, source := d.source, n_chars := d.n_chars)) AS metadata
    FROM r JOIN documents d ON d.doc_id = r.vec_id""")
def search_hits(t: Tables) -> DataFrame:
    """Hits as records: text, other fields as metadata, id and score."""
    hits = _rounded(knn_topk(centroids(t.embeddings), t.embeddings, K, query_id="label"))
    documents = t.documents
    records = documents.select("doc_id", "text", metadata(documents, "doc_id", "text").alias("metadata"))
    return hits.join(records, F.col("vec_id") == F.col("doc_id")).drop("vec_id")


@query("""
    WITH f AS (SELECT label, len(embedding) AS n, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l
               FROM embeddings)
    SELECT label, count(*) AS total, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n = 0) AS empty,
           count(*) FILTER (l = 0) AS zero, min(n) AS min_size, max(n) AS max_size,
           round(min(l), 6) AS min_length, round(max(l), 6) AS max_length, min(n) <> max(n) AS ragged
    FROM f GROUP BY label""")
def vector_health_by_label(t: Tables) -> DataFrame:
    """State of all vectors, in the vector column that the schema shows."""
    vectors = require_columns(t.embeddings, ["embedding"])
    health = vector_health(vectors, vector_column(vectors.schema), "label")
    return health.withColumns({c: F.round(c, 6) for c in ("min_length", "max_length")}).withColumns(
        {c: F.col(c).cast("bigint") for c in ("min_size", "max_size")}
    )


@query("""
    WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i),
    q AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)
    SELECT e.vec_id, label, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6) AS score,
        round(list_distance(q.v, e.embedding::DOUBLE[]), 6) AS distance, 1.0::DOUBLE AS unit_length,
        round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) AS product
    FROM embeddings e JOIN q USING (label)""")
def centre_scores(t: Tables) -> DataFrame:
    """Each vector against the centre of its label."""
    centres = centroids(t.embeddings).withColumnRenamed("embedding", "centre")
    a, b = F.col("centre"), F.col("embedding")
    scores = {"score": cosine(a, b), "distance": l2(a, b), "unit_length": norm(unit(b)), "product": dot(a, b)}
    joined = t.embeddings.join(centres, "label")
    return joined.select("vec_id", "label", *[F.round(c, 6).alias(n) for n, c in scores.items()])
