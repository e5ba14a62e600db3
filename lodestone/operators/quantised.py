"""Search over product-quantised vectors: an index of a few bytes a vector, for corpora whose vectors do not fit.

A vector is cut into sub-spaces, and in each the number of its nearest centroid (a byte) is kept: its code. Centroids come from a bounded
sample; every vector is coded. The index is the codes in k-means cells (`knn.build_cells`). A query visits its nearest cells; there a table of
its distances to the centroids of each sub-space turns a code into a distance by one look-up a sub-space. A matrix product with what the codes
stand for, in single precision, shows first which of them may be among the best; only these are looked up. The `rerank` best of these for
each query, ties by id, meet the stored vectors block by block and are ranked by their exact scores, so what is wrong with codes costs
recall only, never a wrong score or order. Candidates are lists, one for each query and block of vectors, never a row for each pair.

Rows without an id or a vector, and by cosine vectors without length, take no part. Metrics are cosine and l2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lodestone.operators import knn
from lodestone.session import share_package, shared_dir

#: Vectors from which the centroids of sub-spaces are learnt, at most, and centroids of a sub-space: a code is a byte.
SAMPLE = 16_384
CENTROIDS = 256
#: Candidates of a query that are ranked by exact scores.
RERANK = 300
#: Codes of one block that a task holds, and what a row of them takes beside its code, in bytes.
CODE_BYTES = 64 << 20
ROW_BYTES = 24
#: Candidates of one block of queries that a task holds, in bytes.
CANDIDATE_BYTES = 32 << 20
#: Queries whose tables, or whose candidates' scores, a task holds at a time.
AT_ONCE = 1024
#: Codes that are looked up at a time.
LOOKED_UP = 1 << 15


@dataclass
class Index:
    """Codes by cell, and what they stand for."""

    codes: DataFrame  # _cell, _cid, _code
    cells: knn.Cells
    books: np.ndarray  # sub-space, centroid, value
    metric: str
    code_bytes: int
    vector_bytes: int


def _kmeans(x: np.ndarray, count: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids of some points; a centroid that loses its points moves to a random one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:count]].astype(float)
    for _ in range(rounds):
        near = knn._distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        many = np.bincount(near, minlength=len(centres))
        lost = many == 0
        centres = sums / np.maximum(many, 1)[:, None]
        centres[lost] = x[rng.integers(len(x), size=int(lost.sum()))]
    return centres


def train_books(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Centroids of each sub-space (part, centroid, value); vectors are padded to whole sub-spaces with zeros."""
    width = -(-vectors.shape[1] // parts)
    padded = np.pad(vectors, ((0, 0), (0, parts * width - vectors.shape[1])))
    books = np.full((parts, CENTROIDS, width), np.inf)
    for part in range(parts):
        found = _kmeans(padded[:, part * width : (part + 1) * width], min(CENTROIDS, len(padded)), seed=part)
        books[part, : len(found)] = found
    return books


def encode(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest centroid of each sub-space, a byte each."""
    parts, _, width = books.shape
    padded = np.pad(vectors, ((0, 0), (0, parts * width - vectors.shape[1])))
    out = np.empty((len(vectors), parts), np.uint8)
    for part in range(parts):
        real = books[part][np.isfinite(books[part][:, 0])]
        out[:, part] = knn._distances(padded[:, part * width : (part + 1) * width], real).argmin(axis=1)
    return out


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of each query to the centroids of each sub-space (query, part, centroid)."""
    parts, _, width = books.shape
    padded = np.pad(queries, ((0, 0), (0, parts * width - queries.shape[1])))
    out = np.full((len(queries), parts, CENTROIDS), np.inf)
    for part in range(parts):
        real = np.isfinite(books[part][:, 0])
        out[:, part, real] = np.square(knn._distances(padded[:, part * width : (part + 1) * width], books[part][real]))
    return out


def build_index(
    corpus: DataFrame, metric: str = "cosine", corpus_id: str = "vec_id", corpus_vec: str = "embedding", parts: int = 16,
    n_cells: int | None = None, sample: int = SAMPLE,
) -> Index:
    """Codes of every vector of the corpus in `parts` bytes each; the driver sees `sample` vectors at most."""
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    spark = corpus.sparkSession
    share_package(spark)
    cells = knn.build_cells(corpus, metric, corpus_id, corpus_vec, n_cells)
    total = int(cells.sizes.sum())
    chosen = cells.rows.select("_vec").where(F.pmod(F.xxhash64("_cid"), F.lit(max(1, total // sample))) == 0).limit(sample).toArrow()
    if chosen.num_rows:
        vectors = knn._prepared(knn._matrix(chosen.column("_vec")), metric)
        books = train_books(vectors, parts)
    else:
        vectors, books = np.zeros((0, parts)), np.full((parts, CENTROIDS, 1), np.inf)
    shared = spark.sparkContext.broadcast(books)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                raw = [row.tobytes() for row in encode(knn._prepared(knn._matrix(batch.column("_vec")), metric), shared.value)]
                yield pa.RecordBatch.from_arrays([batch.column("_cell"), batch.column("_cid"), pa.array(raw, pa.binary())], ["_cell", "_cid", "_code"])

    kinds = [T.StructField("_cell", T.IntegerType()), T.StructField("_cid", cells.rows.schema["_cid"].dataType), T.StructField("_code", T.BinaryType())]
    path = shared_dir(spark, "codes")
    cells.rows.mapInArrow(code, T.StructType(kinds)).write.parquet(path)
    return Index(spark.read.parquet(path), cells, books, metric, total * parts, total * 4 * vectors.shape[1])


def _approximate(index: Index, rerank: int, several: bool = False):
    """The `rerank` codes of a block that look nearest to each query of a block, of the cells that the query visits: lists by place (`_c`).

    With `several` blocks of codes, for each query id; otherwise for each row of queries.
    """
    books, metric = index.books, index.metric

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _lists_of(left, right, np.zeros(0, int), np.zeros(0, int))
        codes, vectors = _codes(right["_code"]), knn._prepared(knn._matrix(left["_vec"]), metric)
        places, order = knn._ranked(knn._ids(right["_cid"]))
        visits = list(knn._visits(left, right))
        decoded = _Decoded(books) if knn._Single.fits(vectors, books[np.isfinite(books)]) else None
        # Each row of queries has a list of its own, unless several share an id.
        which = np.unique(knn._ids(left["_qid"]), return_inverse=True)[1].ravel()
        alone = len(which) == which.max() + 1
        found, lists = [], []
        for start in range(0, len(vectors), AT_ONCE):
            part = slice(start, start + AT_ONCE)
            some = vectors[part]
            look, held = tables(some, books), knn._Held(len(some), rerank)
            single = decoded and knn._Single(np.pad(some, ((0, 0), (0, decoded.width - some.shape[1]))), decoded.largest, True)
            for mine, theirs in visits:
                rows = np.arange(len(some)) if isinstance(mine, slice) else _within(mine, part)
                cells = np.arange(len(codes)) if isinstance(theirs, slice) else theirs
                for first in range(0, len(cells) if len(rows) else 0, knn.SCORED_ROWS):
                    cols = cells[first : first + knn.SCORED_ROWS]
                    _look_up(look, rows, codes[cols], places[cols], held, single, decoded)
            rows, place, far = held.kept()
            if alone:
                lists.append(_lists_of(left, right, rows + start, order[place], far if several else None))
            else:
                found.append((rows + start, place, far))
        if not alone:
            rows, place, far = (np.concatenate(column) for column in zip(*found, strict=True))
            lists.append(_lists_of(left, right, *_by_id(which, rows, place, far, rerank, order, several)))
        return pa.concat_tables(lists)

    return score


class _Decoded:
    """What codes stand for, ready for products in single precision."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        squares = np.where(np.isfinite(books), np.square(books), 0.0).sum(axis=2)
        self.largest = float(np.sqrt(squares.max(axis=1).sum()))
        self.width = books.shape[0] * books.shape[2]

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.books), self.books.shape[2]), np.float32)
        for part, book in enumerate(self.books):
            out[:, part] = book[codes[:, part]]
        return out.reshape(len(codes), -1)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Codes of one length as rows of bytes."""
    column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _within(rows: np.ndarray, part: slice) -> np.ndarray:
    """Those of ascending row numbers that lie in a part, counted from its start."""
    return rows[slice(*np.searchsorted(rows, [part.start, part.stop]))] - part.start


def _look_up(look: np.ndarray, rows: np.ndarray, codes: np.ndarray, places: np.ndarray, held, single, decoded) -> None:
    """Holds the codes that may be among the best of some queries, by what they are looked up as."""
    if single is not None:
        floor = held.floor[rows]
        near, cols = single.near(rows, single.corpus(decoded.of(codes)), floor, held.k if np.isneginf(floor).any() else 0)
        if len(near) <= 4 * held.k * len(rows):
            held.add(rows[near], places[cols], -_looked_up_pairs(look, rows[near], codes, cols))
            return
    block = np.ascontiguousarray(codes.T.astype(np.intp))
    for row in rows:
        far = _looked_up(look[row], block)
        best = _least(far, places, held.k)
        held.add(np.full(len(best), row), places[best], -far[best])


def _by_id(which: np.ndarray, rows: np.ndarray, place: np.ndarray, score: np.ndarray, rerank: int, order: np.ndarray, once: bool):
    """(row, position, score) of candidates; rows of one query id (`which`) share the best of all of theirs."""
    keep = knn._best(which[rows], place, score, rerank)
    group, place, score = which[rows][keep], place[keep], score[keep]
    by_row = np.argsort(which, kind="stable")
    # Each row of an id gets the list of the id, or one of them does.
    first, last = (np.searchsorted(which[by_row], group, side=side) for side in ("left", "right"))
    times = np.minimum(last - first, 1) if once else last - first
    rows = by_row[np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    return rows, order[np.repeat(place, times)], np.repeat(score, times)


def _lists_of(left: pa.Table, right: pa.Table, rows: np.ndarray, cols: np.ndarray, score: np.ndarray | None = None) -> pa.Table:
    """Candidates as lists: one row for each query and place, with the vector of the query, and with scores if they are given."""
    where = right["_c"].to_numpy()[cols]
    by = np.lexsort((where, rows))
    rows, cols, where = rows[by], cols[by], where[by]
    start = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(where) != 0)]) if len(rows) else np.zeros(0, int)
    offsets, at = pa.array(np.r_[start, len(rows)], pa.int32()), pa.array(rows[start])
    ids = right["_cid"].take(pa.array(cols)).combine_chunks()
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    return pa.table({
        "_qid": left["_qid"].take(at), "_c": pa.array(where[start], pa.int32()), "_cids": pa.ListArray.from_arrays(offsets, ids),
        "_scores": pa.nulls(len(at), pa.list_(pa.float64())) if score is None else pa.ListArray.from_arrays(offsets, pa.array(score[by], pa.float64())), "_vec": left["_vec"].take(at),
    })


def _looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The distance of each code (sub-space, code) by a table of distances (sub-space, centroid), a slice that caches hold at a time."""
    far = np.empty(codes.shape[1])
    for start in range(0, len(far), LOOKED_UP):
        at = slice(start, start + LOOKED_UP)
        far[at] = table[0][codes[0, at]]
        for own, code in zip(table[1:], codes[1:, at], strict=True):
            far[at] += own[code]
    return far


def _looked_up_pairs(look: np.ndarray, rows: np.ndarray, codes: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The distance of single pairs of a query's table and a code, added up in the order of the sub-spaces, as `_looked_up` does."""
    far, values = np.empty(len(rows)), look.reshape(-1)
    starts = np.arange(codes.shape[1])[:, None] * CENTROIDS
    for start in range(0, len(rows), LOOKED_UP):
        at = slice(start, start + LOOKED_UP)
        far[at] = values.take(starts + codes[cols[at]].T + rows[at] * (codes.shape[1] * CENTROIDS)).sum(axis=0)
    return far


def _least(far: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` least distances, ties by id."""
    if len(far) <= most:
        return np.arange(len(far))
    near = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
    return near if len(near) == most else near[np.lexsort((ids[near], far[near]))[:most]]


def _candidates_scorer(k: int, metric: str):
    """The k best of the candidates (`_cids`) of each query of a block that lie in a block of the corpus."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"_qid": left["_qid"].slice(0, 0), "_cid": right["_cid"].slice(0, 0), "_score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, lists = knn._ids(right["_cid"]), left["_cids"].combine_chunks()
        queries, corpus = (knn._prepared(knn._matrix(side["_vec"]), metric) for side in (left, right))
        order = np.argsort(ids, kind="stable")
        sorted_ids, found = ids[order], [empty]
        for start in range(0, left.num_rows, AT_ONCE):
            some = lists.slice(start, AT_ONCE)
            wanted = knn._ids(some.flatten())
            rows = np.repeat(np.arange(len(some)) + start, np.diff(some.offsets.to_numpy()))
            # An id that several vectors share stands for each of them.
            low, high = (np.searchsorted(sorted_ids, wanted, side=side) for side in ("left", "right"))
            times = high - low
            cols = order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            rows = np.repeat(rows, times)
            value = knn._exact(queries, corpus, rows, cols, metric)
            keep = knn._best(rows, ids[cols], value, k)
            found.append(pa.table({"_qid": left["_qid"].take(pa.array(rows[keep])), "_cid": right["_cid"].take(pa.array(cols[keep])), "_score": value[keep]}))
        return pa.concat_tables(found)

    return score


def _merged(lists: DataFrame, queries: DataFrame, rerank: int) -> DataFrame:
    """The best `rerank` candidates of each query over several blocks of codes."""
    flat = lists.select("_qid", "_c", F.explode(F.arrays_zip("_cids", "_scores")).alias("_one")).select("_qid", "_c", "_one._cids", "_one._scores")
    best = Window.partitionBy("_qid").orderBy(F.desc("_scores"), "_cids")
    near = flat.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= rerank)
    return near.groupBy("_qid", "_c").agg(F.collect_list("_cids").alias("_cids"), F.collect_list("_scores").alias("_scores")).join(queries, "_qid")


def search(
    queries: DataFrame, index: Index, k: int, probes: int = 8, rerank: int = RERANK, query_id: str = "query_id", query_vec: str = "embedding",
    corpus_id: str = "vec_id",
) -> DataFrame:
    """(query id, corpus id, score, rank): the k nearest by exact score of the `rerank` that codes put first in the `probes` nearest cells."""
    q = knn._side(queries, query_id, query_vec, "_qid")
    if not index.cells.sizes.any():
        q = q.limit(0)
    spark, width = q.sparkSession, index.cells.centroids.shape[1]
    total, n = int(index.cells.sizes.sum()), q.count()
    c_parts = max(1, -(-total // knn._block_rows(spark, total, width)))
    q_parts = max(1, -(-n // knn._block_rows(spark, n, width)))
    place = F.pmod(F.xxhash64("_cid"), F.lit(c_parts)).cast("int").alias("_c")
    # Codes are small, so that most corpora are one block or a few, and a query gives `rerank` candidates for each of them.
    q_rows = max(1, min(CANDIDATE_BYTES // (8 * max(width, rerank)), -(-n // (knn.BLOCKS_A_CORE * spark.sparkContext.defaultParallelism))))
    c_rows = max(1, CODE_BYTES // (index.books.shape[0] + ROW_BYTES))
    groups, types = knn._dealt(q, index.codes.select("*", place), index.cells, probes, q_rows, c_rows)
    kinds = {"_qid": types["_qid"].dataType, "_c": T.IntegerType(), "_cids": T.ArrayType(types["_cid"].dataType), "_scores": T.ArrayType(T.DoubleType()),
             "_vec": q.schema["_vec"].dataType}
    several = int(sum(knn._packed(index.cells.sizes, c_rows)).max(initial=0)) > 1
    lists = groups.applyInArrow(_approximate(index, rerank, several), T.StructType([T.StructField(*kind) for kind in kinds.items()]))
    if several:
        lists = _merged(lists, knn._ready(q, "_qid", index.metric), rerank)
    left = lists.drop("_scores").withColumn("_q", F.pmod(F.xxhash64("_qid"), F.lit(q_parts)).cast("int"))
    right = index.cells.rows.select("_cid", "_vec", place).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    exact = knn._paired(left, right, ["_q", "_c"], q_parts * c_parts).applyInArrow(_candidates_scorer(k, index.metric), types)
    out_id = corpus_id if corpus_id != query_id else f"neighbour_{corpus_id}"
    return knn._top(exact, k, index.metric, query_id, out_id)
