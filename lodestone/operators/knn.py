"""Nearest neighbours of query vectors in a corpus: exact, and approximate by cells.

`knn_topk` is exact. Queries that are few, by number and bytes, are broadcast, and the corpus is scanned once; more of them are cut into
blocks, as the corpus is, and every pair of blocks is a group of one task, so the plan is the same for any number of queries and the
driver sees none of them. Either way a task scores by matrix products and keeps k rows per query, so no pair of vectors ever becomes a
row. `knn_by_cells` searches the cells of the nearest centroids only; both sides are cut into bounded blocks by cell.

Rows are ranked by their exact scores, the same arithmetic for each pair wherever it stands; the lower id goes first among equal
scores only. Rows without an id or a vector, and by cosine vectors without length, take no part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lodestone.functions.vectors import METRICS
from lodestone.session import kept, shared_dir

# Executors get this module with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries that are broadcast at most, by number and by size.
MAX_QUERIES = 8192
MAX_BROADCAST_BYTES = 64 << 20
# Scores of one matrix product, at most: 8 bytes each.
MAX_SCORES = 4 << 20
# Vectors from which a centroid is found, and the most cells there are.
SAMPLE_PER_CELL = 256
MAX_CELLS = 4096
# Vectors of one side of a block that a single task holds, as doubles. Large blocks mean few copies in the shuffle, small ones little memory.
BLOCK_BYTES = 32 << 20
# Blocks are smaller where there would not be so many of them for each core, but not below so many rows.
BLOCKS_A_CORE = 4
LEAST_ROWS = 1024
# Corpus rows that are scored at a time; those after them have to beat what the first ones gave.
SCORED_ROWS = 4096
# Values below which no product of two vectors overflows, and those for products in single precision.
TAME = 1e150
SINGLE_TAME = 1e15
# Times that single precision may leave too much of a block.
MISSES = 8
# Tasks over which pairs of blocks are dealt, at most.
MAX_TASKS = 2000


def _matrix(column) -> np.ndarray:
    """Float64 rows of an Arrow list column; vectors of another length than the first are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if rows and (flat.size % rows or np.any(np.diff(column.offsets.to_numpy()) != flat.size // rows)):
        raise ValueError("vectors of different length")
    return flat.reshape(rows, -1)


def _prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Unit rows for the cosine; a row without length becomes nan, so it never scores."""
    if metric != "cosine":
        return vectors
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _best(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of each query, ties by id."""
    order = np.lexsort((ids, -score, queries))
    sorted_queries = queries[order]
    first = np.searchsorted(sorted_queries, sorted_queries, side="left")
    return order[np.arange(len(order)) - first < k]


def _lowest_copies(c: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k lowest ids of each distinct vector. Copies tie, so no other one can be a result."""
    whole = np.ascontiguousarray(c)
    whole = whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel()
    group = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], group[order], side="left")
    return np.sort(order[np.arange(len(order)) - first < k])


def _exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Scores of single pairs, in slices: many copies of a vector can give many near pairs."""
    out = np.empty(len(rows))
    step = max(1, MAX_SCORES // max(1, q.shape[1]))
    for start in range(0, len(rows), step):
        a, b = q[rows[start : start + step]], c[cols[start : start + step]]
        if metric == "l2":
            out[start : start + step] = -np.sqrt(np.square(a - b).sum(axis=1))
        else:
            out[start : start + step] = (a * b).sum(axis=1)
    return out


def _slack(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """How far, at most, a score of the matrix product may be from the exact one, for each query."""
    size = np.sqrt(np.square(q).sum(axis=1))
    largest = np.sqrt(np.nanmax(np.square(c).sum(axis=1), initial=0.0))
    scale = np.square(size + largest) if metric == "l2" else size * largest
    return 16 * (q.shape[1] + 4) * np.finfo(float).eps * np.nan_to_num(scale)


def _block_topk(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: str, floor: np.ndarray | None = None):
    """k best corpus rows of each query row: (query row, id, score), higher scores better.

    `floor` is the k-th best score of each query so far; rows below it are left out.
    """
    if q.shape[1] != c.shape[1] and len(q) and len(c):
        raise ValueError(f"query vectors have {q.shape[1]} dimensions, corpus vectors {c.shape[1]}")
    score = q @ c.T
    if metric == "l2":
        score *= 2
        score -= np.square(q).sum(axis=1)[:, None]
        score -= np.square(c).sum(axis=1)[None, :]
    tame = max((np.abs(side).max(initial=0.0) for side in (q, c))) < TAME
    if not tame:
        score = np.where(np.isnan(score), -np.inf, score)
    limit = np.full(len(q), -np.inf)
    if floor is not None:
        limit = np.where(np.isneginf(floor), floor, -np.square(floor)) if metric == "l2" else floor
    if score.shape[1] > k and np.isneginf(limit).any():
        limit = np.maximum(limit, np.partition(score, -k, axis=1)[:, -k])
    # Everything near the limit stays until exact scores decide.
    near = score >= (limit - 2 * _slack(q, c, metric))[:, None]
    if not tame:
        near &= score > -np.inf
    if np.count_nonzero(near) > 4 * k * len(q):
        kept_rows = _lowest_copies(c, ids, k)
        near, c, ids = near[:, kept_rows], c[kept_rows], ids[kept_rows]
    rows, cols = np.divmod(np.flatnonzero(near), max(1, len(c)))
    exact = _exact(q, c, rows, cols, metric)
    keep = _best(rows, ids[cols], exact, k)
    return rows[keep], ids[cols][keep], exact[keep]


class _Held:
    """The k best of each query so far, and some more that are not yet compared: (query row, id, score), higher scores better, ties by id.

    `floor` is the k-th best score of each query when they were compared last; rows below it need not come.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.width, self.waiting = k, 3 * k + 32, 0
        self.score = np.full((queries, self.width), -np.inf)
        self.id = np.zeros((queries, self.width), np.int64)
        self.fill = np.zeros(queries, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Query rows ascend. Those with more rows than there is room for are taken in turns."""
        if not len(rows):
            return
        score, nth = np.where(np.isnan(score), -np.inf, score), _nth(rows)
        turn = nth // (self.width - self.k)
        last = int(turn.max())
        for now in range(last + 1):
            some = slice(None) if not last else np.flatnonzero(turn == now)
            self._put(rows[some], ids[some], score[some], nth[some] - now * (self.width - self.k))
        if self.waiting >= self.k * len(self.fill):
            self.cut()

    def _put(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, nth: np.ndarray) -> None:
        many = np.bincount(rows, minlength=len(self.fill))
        if (self.fill + many).max() > self.width:
            self.cut()
        at = self.fill[rows] + nth
        self.score[rows, at], self.id[rows, at] = score, ids
        self.fill += many
        self.waiting += len(rows)

    def cut(self) -> None:
        """Leaves the k best of each query."""
        self.waiting = 0
        if self.fill.max(initial=0) > self.k:
            limit = np.partition(self.score, -self.k, axis=1)[:, -self.k]
            keep = (self.score >= limit[:, None]) & (np.arange(self.width) < self.fill[:, None])
            many = keep.sum(axis=1)
            tied = np.flatnonzero(many > self.k)
            if len(tied):
                row, at = np.nonzero(keep[tied])
                best = _best(row, self.id[tied[row], at], self.score[tied[row], at], self.k)
                keep[tied] = False
                keep[tied[row[best]], at[best]] = True
                many[tied] = self.k
            row, at = np.nonzero(keep)
            score, ids, to = self.score[row, at], self.id[row, at], _nth(row)
            self.score.fill(-np.inf)
            self.score[row, to], self.id[row, to], self.fill = score, ids, many
        self.floor = self.score[:, : self.k].min(axis=1)

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, in no order but of queries."""
        self.cut()
        row, at = np.nonzero(np.arange(self.width) < self.fill[:, None])
        return row, self.id[row, at], self.score[row, at]


def _nth(rows: np.ndarray) -> np.ndarray:
    """How many equal ones stand before each of ascending numbers."""
    many = np.bincount(rows)
    return np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, order): numbers that rank like the ids, and the position of each of these numbers."""
    order = np.argsort(ids, kind="stable")
    places = np.empty(len(ids), np.int64)
    places[order] = np.arange(len(ids))
    return places, order


class _Single:
    """Matrix products in single precision, to leave out what cannot be among the best; what stays needs exact scores.

    `squared` is for distances: scores are minus the square of the distance, otherwise they are the product.
    """

    def __init__(self, queries: np.ndarray, largest: float, squared: bool):
        squares = _squares(queries)
        size = np.sqrt(squares)
        self.squared = squared
        self.queries = _augmented(queries, np.full(len(queries), 0.5 if squared else 0.0))
        self.queries *= 2 if squared else 1
        self.shift = squares if squared else np.zeros(len(queries))
        scale = np.square(size + largest) if squared else size * largest
        # The least number of single precision adds to what is lost below it.
        self.slack = 16 * (queries.shape[1] + 5) * (np.finfo(np.float32).eps * scale + 1e-37 * (1 + size + largest))
        self.room = np.empty(0, np.float32)

    @staticmethod
    def fits(*sides: np.ndarray) -> bool:
        """Whether squares and products of all values are numbers in single precision; not, if some value is none."""
        return all(bool(side.max(initial=0.0) < SINGLE_TAME and side.min(initial=0.0) > -SINGLE_TAME) for side in sides)

    def corpus(self, vectors: np.ndarray) -> np.ndarray:
        return _augmented(vectors, -_squares(vectors) if self.squared else np.zeros(len(vectors)))

    def near(self, rows: slice | np.ndarray, corpus: np.ndarray, floor: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query row, corpus row) of all whose exact score may reach the floor, and may be among the `best` of this corpus if that is given."""
        q = self.queries[rows]
        size = len(q) * len(corpus)
        if len(self.room) < size:
            self.room = np.empty(size, np.float32)
        score = np.matmul(q, corpus.T, out=self.room[:size].reshape(len(q), len(corpus)))
        bar = floor + self.shift[rows]
        if 0 < best < len(corpus):
            bar = np.maximum(bar, _low_bar(score, best))
        hit = score >= (bar - 2 * self.slack[rows]).astype(np.float32)[:, None]
        if size % 8:
            flat = np.flatnonzero(hit)
        else:
            # Few are near: they are looked for eight at a time.
            eight = np.flatnonzero(hit.reshape(-1).view(np.uint64))
            flat = (eight[:, None] * 8 + np.arange(8))[hit.reshape(-1, 8)[eight]]
        return np.divmod(flat, max(1, len(corpus)))


def _low_bar(score: np.ndarray, best: int) -> np.ndarray:
    """What the `best`-th score of each row is at least: that many of the largest ones of groups of columns are, and groups are few to sort."""
    group = max(1, score.shape[1] // (8 * best))
    columns = score.shape[1] // group
    most = score[:, : columns * group].reshape(len(score), group, columns).max(axis=1) if group > 1 else score
    return np.partition(most, -best, axis=1)[:, -best]


def _augmented(vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One column more, even of zeros: rows of a power of two of bytes share places in caches, which makes products a fifth slower."""
    out = np.empty((len(vectors), vectors.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = vectors, last
    return out


def _squares(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


def _steps(rows: int, other: int) -> Iterator[slice]:
    step = max(1, MAX_SCORES // max(1, other))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def _scan(queries: np.ndarray, k: int, metric: str, batches):
    """k best rows per query of one corpus partition."""
    q = _prepared(queries, metric)
    floor = np.full(len(q), -np.inf)
    held, waiting = [], 0

    def merge():
        rows, ids, score = (np.concatenate(column) for column in zip(*held))
        keep = _best(rows, ids, score, k)
        rows, ids, score = rows[keep], ids[keep], score[keep]
        floor[:] = _floor(len(q), rows, score, k)
        return [(rows, ids, score)]

    for batch in batches:
        c = _prepared(_matrix(batch.column("_vec")), metric)
        ids = _ids(batch.column("_cid"))
        for part in _steps(len(c), len(q)):
            found = _block_topk(q, c[part], ids[part], k, metric, floor)
            held.append(found)
            waiting += len(found[0])
            if waiting >= len(q) * k:
                held, waiting = merge(), 0
    return merge()[0] if held else None


def _metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return metric


def _side(df: DataFrame, id_col: str, vec_col: str, out_id: str) -> DataFrame:
    """Id and vector only, without null or empty vectors and without null ids, which are whole numbers or texts."""
    vec = F.col(f"`{vec_col}`")
    if not isinstance(df.schema[id_col].dataType, (T.IntegralType, T.StringType)):
        raise ValueError(f"ids must be whole numbers or texts: {id_col}")
    if not isinstance(df.schema[vec_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        vec = vec.cast("array<double>")
    return df.select(F.col(f"`{id_col}`").alias(out_id), vec.alias("_vec")).where(
        (F.size("_vec") > 0) & F.col(out_id).isNotNull()
    )


def _top(scored: DataFrame, k: int, metric: str, query_id: str, corpus_id: str) -> DataFrame:
    """Final rank per query, over k rows of each task that scored it; Spark cuts those of a map task to k again."""
    best = [F.col("_score").desc(), F.col("_cid").asc()]
    score = -F.col("_score") if metric == "l2" else F.col("_score")
    return (
        scored.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy(*best)))
        .where(F.col("rank") <= k)
        .select(F.col("_qid").alias(query_id), F.col("_cid").alias(corpus_id), score.alias("score"), "rank")
    )


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "cosine",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    corpus_id: str = "vec_id",
    corpus_vec: str = "embedding",
    max_queries: int = MAX_QUERIES,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest corpus rows of every query: (query id, corpus id, score, rank).

    The queries are counted first. Up to `max_queries` of them, and `max_broadcast_bytes`, go to every task of one scan of the corpus; more
    are dealt by a hash of the id over blocks, and meet every block of the corpus in a task of their own, where at most `max_queries` are
    scored at a time.
    """
    _metric(metric)
    q = _side(queries, query_id, query_vec, "_qid")
    c = _side(corpus, corpus_id, corpus_vec, "_cid")
    out_corpus_id = corpus_id if corpus_id != query_id else f"neighbour_{corpus_id}"
    size = q.agg(F.count("*").alias("n"), F.sum(F.size("_vec")).alias("values")).first()
    if size["n"] <= max_queries and 8 * (size["values"] or 0) <= max_broadcast_bytes:
        found = _broadcast(q.toArrow(), c, k, metric, _scored(q, c))
    else:
        found = _by_blocks(q, c, k, metric, size["n"], max(1, size["values"] // size["n"]), max_queries)
    return _top(found, k, metric, query_id, out_corpus_id)


def _scored(q: DataFrame, c: DataFrame) -> T.StructType:
    kinds = [("_qid", q.schema["_qid"].dataType), ("_cid", c.schema["_cid"].dataType), ("_score", T.DoubleType())]
    return T.StructType([T.StructField(*kind) for kind in kinds])


def _broadcast(table: pa.Table, corpus: DataFrame, k: int, metric: str, types: T.StructType) -> DataFrame:
    """k best corpus rows of each of some queries, in every task of one scan."""
    if table.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], types)
    qids = table.column("_qid").combine_chunks()
    # Spark's cleaner frees it when the result is no longer referenced.
    shared = corpus.sparkSession.sparkContext.broadcast(_matrix(table.column("_vec")))

    def scan(batches):
        best = _scan(shared.value, k, metric, batches)
        if best is not None:
            rows, ids, score = best
            yield pa.RecordBatch.from_arrays(
                [qids.take(pa.array(rows)), pa.array(ids), pa.array(score)], ["_qid", "_cid", "_score"]
            )

    return corpus.mapInArrow(scan, types)


def _ready(side: DataFrame, id_col: str, metric: str) -> DataFrame:
    """Vectors as they came, without those that can never score. Floats are half as many bytes as what they become for scores."""

    def prepare(batches):
        for batch, _ in _unit_rows(batches, metric):
            yield batch.select([id_col, "_vec"])

    return side.mapInArrow(prepare, T.StructType([T.StructField(name, side.schema[name].dataType) for name in (id_col, "_vec")]))


def _block_rows(spark: SparkSession, rows: int, width: int) -> int:
    """Rows of a block of vectors: what a task can hold, or fewer, so that pairs of blocks keep every core busy."""
    sides = int(np.ceil(np.sqrt(BLOCKS_A_CORE * spark.sparkContext.defaultParallelism)))
    return max(1, min(BLOCK_BYTES // (8 * width), max(LEAST_ROWS, -(-rows // sides))))


def _by_blocks(q: DataFrame, c: DataFrame, k: int, metric: str, n: int, width: int, at_once: int) -> DataFrame:
    """k best corpus rows of each of `n` queries, from each block of the corpus: a group is one block of either side."""
    spark = q.sparkSession
    ready_q, ready_c = kept(_ready(q, "_qid", metric), "queries"), kept(_ready(c, "_cid", metric), "corpus")
    total = ready_c.count()
    q_parts = -(-n // _block_rows(spark, n, width))
    c_parts = max(1, -(-total // _block_rows(spark, total, width)))
    places = {"_q": F.sequence(F.lit(0), F.lit(q_parts - 1)), "_c": F.sequence(F.lit(0), F.lit(c_parts - 1))}
    left = ready_q.withColumn("_q", F.pmod(F.xxhash64("_qid"), F.lit(q_parts)).cast("int")).withColumn("_c", F.explode(places["_c"]))
    right = ready_c.withColumn("_c", F.pmod(F.xxhash64("_cid"), F.lit(c_parts)).cast("int")).withColumn("_q", F.explode(places["_q"]))
    groups = _paired(left, right, ["_q", "_c"], q_parts * c_parts)
    return groups.applyInArrow(_block_scorer(k, metric, at_once), _scored(q, c))


def _paired(left: DataFrame, right: DataFrame, keys: list[str], groups: int):
    """Cogroups by `keys`, dealt over four times as many tasks as there are groups, up to a bound: a group is much work for few bytes, so Spark must
    not join them, and in fewer tasks their hashes would put several into one.
    """
    tasks = max(1, min(4 * groups, MAX_TASKS))
    left, right = (side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right))
    return left.cogroup(right)


def _nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: str, at_once: int = MAX_SCORES) -> list[tuple]:
    """k best rows of `c` for each row of `q`, as (query row, id, score) for slices of `q`.

    The corpus is scored some rows at a time, and what was found so far is a floor for those after them: a product in single precision shows
    which may reach it, and only these get exact scores.
    """
    if q.shape[1] != c.shape[1] and len(q) and len(c):
        raise ValueError(f"query vectors have {q.shape[1]} dimensions, corpus vectors {c.shape[1]}")
    places, order = _ranked(ids)
    single, misses = None, 0
    if len(c) and _Single.fits(q, c):
        single = _Single(q, float(np.sqrt(_squares(c).max())), metric == "l2")
        rough = single.corpus(c)
    out = []
    for part in _steps(len(q), max(SCORED_ROWS, -(-MAX_SCORES // max(1, at_once)))):
        some, held = q[part], _Held(len(q[part]), k)
        for start in range(0, len(c), SCORED_ROWS):
            at = slice(start, start + SCORED_ROWS)
            if single is not None:
                unknown = k if np.isneginf(held.floor).any() else 0
                rows, cols = single.near(part, rough[at], -np.square(held.floor) if metric == "l2" else held.floor, unknown)
                if len(rows) <= 4 * k * len(some):
                    held.add(rows, places[at][cols], _exact(some, c[at], rows, cols, metric))
                    continue
                # Too many are near for single precision, or they are copies; where that is common it is not tried again.
                misses += 1
                single = single if misses < MISSES else None
            held.add(*_block_topk(some, c[at], places[at], k, metric, held.floor))
        rows, found, score = held.kept()
        keep = _best(rows, found, score, k)
        out.append((rows[keep] + part.start, ids[order[found[keep]]], score[keep]))
    return out


def _floor(queries: int, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query, of those held; none for queries of fewer."""
    worst = np.full(queries, np.inf)
    np.minimum.at(worst, rows, score)
    return np.where(np.bincount(rows, minlength=queries) >= k, worst, -np.inf)


def _block_scorer(k: int, metric: str, at_once: int = MAX_SCORES):
    """k best rows of a block for each query of a block: of all its rows, or, if both sides name cells, of those in cells that the query visits."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"_qid": left["_qid"].slice(0, 0), "_cid": right["_cid"].slice(0, 0),
                          "_score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        queries, corpus = (_prepared(_matrix(side["_vec"]), metric) for side in (left, right))
        ids = _ids(right["_cid"])
        found = []
        for mine, theirs in _visits(left, right):
            parts = _nearest(queries[mine], corpus[theirs], ids[theirs], k, metric, at_once)
            found += [(mine[rows], *rest) for rows, *rest in parts] if isinstance(mine, np.ndarray) else parts
        if not found:
            return empty
        rows, cids, value = (np.concatenate(column) for column in zip(*found, strict=True))
        keep = _best(rows, cids, value, k)
        best = pa.table({"_qid": left["_qid"].take(pa.array(rows[keep])), "_cid": pa.array(cids[keep]), "_score": value[keep]})
        return pa.concat_tables([empty, best])

    return score


def _visits(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """(rows of queries, rows of the corpus) to compare: everything at once where every query visits every cell, which no list of cells says too."""
    if "_cell" not in right.column_names:
        yield slice(None), slice(None)
        return
    wanted = left["_cells"].combine_chunks()
    if wanted.null_count == len(wanted):
        yield slice(None), slice(None)
        return
    query = np.repeat(np.arange(left.num_rows), np.diff(wanted.offsets.to_numpy()))
    visited, cells = wanted.flatten().to_numpy(), right["_cell"].combine_chunks().to_numpy()
    here = np.unique(cells)
    if len(visited) == left.num_rows * len(here) and np.array_equal(np.unique(visited), here):
        yield slice(None), slice(None)
        return
    by_query, by_row = np.argsort(visited, kind="stable"), np.argsort(cells, kind="stable")
    for cell in here:
        mine = query[by_query[slice(*np.searchsorted(visited[by_query], [cell, cell + 1]))]]
        theirs = by_row[slice(*np.searchsorted(cells[by_row], [cell, cell + 1]))]
        if len(mine):
            yield mine, theirs


@dataclass
class Cells:
    """A corpus split by nearest centroid."""

    rows: DataFrame  # _cell, _cid, _vec as it came
    centroids: np.ndarray
    sizes: np.ndarray
    metric: str


def train_centroids(vectors: DataFrame, n_cells: int, total: int, sample_per_cell: int = SAMPLE_PER_CELL, seed: int = 7):
    """K-means centroids from a sample of about `sample_per_cell` vectors per cell; the sample only places the cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample_per_cell * n_cells / max(1, total))
    sample = vectors.sample(share, seed) if share < 1.0 else vectors
    points = sample.select(array_to_vector("_vec").alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=5, initMode="random").fit(points)
    return np.array(model.clusterCenters())


def _unit_rows(batches, metric: str):
    """Arrow batches with vectors ready for distances; rows that can never score are left out."""
    for batch in batches:
        vectors = _prepared(_matrix(batch.column("_vec")), metric)
        keep = np.flatnonzero(~np.isnan(vectors).any(axis=1)) if len(vectors) else np.array([], int)
        if len(keep):
            yield batch.take(pa.array(keep)), vectors[keep]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _lists(vectors: np.ndarray) -> pa.Array:
    rows, width = vectors.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(vectors.ravel())
    )


def build_cells(
    corpus: DataFrame,
    metric: str = "cosine",
    corpus_id: str = "vec_id",
    corpus_vec: str = "embedding",
    n_cells: int | None = None,
    path: str | None = None,
    sample_per_cell: int = SAMPLE_PER_CELL,
    max_cells: int = MAX_CELLS,
) -> Cells:
    """Assign every corpus vector to its nearest centroid. An empty corpus has one cell without rows.

    Without `n_cells` there are about half the square root of the corpus, and `max_cells` at most. The centroids come from a
    sample of about `sample_per_cell` vectors per cell; every vector is assigned.

    The result is stored below the shared folder, or at `path` for later searches, so that it is found once.
    """
    _metric(metric)
    c = _side(corpus, corpus_id, corpus_vec, "_cid")
    total = c.count()
    # About the square root of the corpus, so that cells and rows per cell grow alike.
    n_cells = n_cells or int(min(max_cells, max(1, round(total**0.5 / 2))))
    n_cells = max(1, min(n_cells, total or 1))

    def ready(batches):
        for batch, vectors in _unit_rows(batches, metric):
            yield pa.RecordBatch.from_arrays([_lists(vectors)], ["_vec"])

    usable = c.select("_vec").mapInArrow(ready, "_vec array<double>")
    first = usable.first()
    if first is None or n_cells == 1:
        # One cell is everything; where its centre lies does not matter.
        centroids = np.zeros((1, len(first[0]) if first else 1))
    else:
        centroids = train_centroids(usable, n_cells, total, sample_per_cell)
    n_cells = len(centroids)
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch, vectors in _unit_rows(batches, metric):
            for part in _steps(len(vectors), n_cells):
                far = _distances(vectors[part], shared.value)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.astype(np.int32)),
                        batch.column("_cid").slice(part.start, len(cell)),
                        batch.column("_vec").slice(part.start, len(cell)),
                    ],
                    ["_cell", "_cid", "_vec"],
                )

    types = T.StructType(
        [
            T.StructField("_cell", T.IntegerType()),
            T.StructField("_cid", c.schema["_cid"].dataType),
            T.StructField("_vec", c.schema["_vec"].dataType),
        ]
    )
    path = path or shared_dir(corpus.sparkSession, "cells")
    c.mapInArrow(assign, types).write.mode("overwrite").parquet(path)
    rows = corpus.sparkSession.read.parquet(path)
    sizes = np.zeros(n_cells, np.int64)
    # One row per cell comes back: at most `max_cells`.
    for row in rows.groupBy("_cell").agg(F.count("*").alias("n")).collect():
        sizes[row["_cell"]] = row["n"]
    return Cells(rows, centroids, sizes, metric)


def _packed(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and how many it is cut into: small neighbouring cells share a block, a large one has several."""
    first, parts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    block, room = -1, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > block_rows:
            first[cell], parts[cell] = block + 1, -(-n // block_rows)
            block, room = block + int(parts[cell]), 0
        elif n:
            if n > room:
                block, room = block + 1, block_rows
            first[cell], parts[cell], room = block, 1, room - n
    return first, parts


def _route(queries: DataFrame, cells: Cells, probes: int, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """One row per query and block (`_b`) that holds some of its `probes` nearest cells, with these cells: a query is not copied to each cell."""
    centroids, metric = cells.centroids, cells.metric
    probes = min(probes, len(centroids))

    def route(batches):
        for batch, vectors in _unit_rows(batches, metric):
            # Bounds the distances of a slice, and the vectors that are copied to its blocks.
            for part in _steps(len(vectors), max(len(centroids), probes * vectors.shape[1])):
                some = vectors[part]
                if probes == len(centroids):
                    cell = np.tile(np.arange(probes), len(some))
                else:
                    cell = np.sort(_distances(some, centroids).argsort(axis=1)[:, :probes], axis=1).ravel()
                row, times = np.repeat(np.arange(len(some)), probes), parts[cell]
                block = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                # Rows and blocks ascend, so the cells of one visit are neighbours.
                start = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(block) != 0)]) if len(row) else np.zeros(0, np.int64)
                at = np.arange(len(batch))[part][row[start]]
                if probes == len(centroids):
                    lists = pa.nulls(len(start), pa.list_(pa.int32()))  # every cell
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[start], pa.int32()),
                        batch.column("_qid").take(pa.array(at)),
                        lists,
                        batch.column("_vec").take(pa.array(at)),
                    ],
                    ["_b", "_qid", "_cells", "_vec"],
                )

    types = T.StructType(
        [
            T.StructField("_b", T.IntegerType()),
            T.StructField("_qid", queries.schema["_qid"].dataType),
            T.StructField("_cells", T.ArrayType(T.IntegerType())),
            T.StructField("_vec", queries.schema["_vec"].dataType),
        ]
    )
    return queries.mapInArrow(route, types)


def _dealt(queries: DataFrame, rows: DataFrame, cells: Cells, probes: int, q_rows: int, c_rows: int):
    """Cogroups of queries and what is stored of the rows of the cells they visit, block by block, and the type of what is scored.

    Cells are packed into blocks of about `c_rows` rows, and the queries of a block into parts of about `q_rows`; each pair is one group, so
    neither a full cell nor a popular one lands in one task, and a query is shuffled once for each block it visits, however many cells.
    """
    spark = queries.sparkSession
    first, parts = _packed(cells.sizes, c_rows)
    routed = _route(queries, cells, probes, first, parts)
    # One row per block: small enough to fetch, and to broadcast.
    load = {row["_b"]: -(-row["count"] // q_rows) for row in routed.groupBy("_b").count().collect()}
    places = [
        (cell, int(first[cell]), [load.get(b, 0) for b in range(first[cell], first[cell] + parts[cell])]) for cell in np.flatnonzero(parts).tolist()
    ]
    blocks = F.broadcast(spark.createDataFrame(list(load.items()), "_b int, _q_parts long"))
    q = routed.join(blocks, "_b").withColumn("_q", F.pmod(F.xxhash64("_qid"), F.col("_q_parts"))).drop("_q_parts")
    c = (
        rows.join(F.broadcast(spark.createDataFrame(places, "_cell int, _first int, _q_parts array<long>")), "_cell")
        .withColumn("_at", F.pmod(F.xxhash64("_cid"), F.size("_q_parts")).cast("int"))
        .withColumn("_q_parts", F.get("_q_parts", F.col("_at")))
        .where("_q_parts > 0")
        .withColumn("_b", F.col("_first") + F.col("_at"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q_parts") - 1)))
        .drop("_first", "_at", "_q_parts")
    )
    return _paired(q, c, ["_b", "_q"], sum(load.values())), _scored(queries, rows)


def knn_by_cells(
    queries: DataFrame,
    corpus: DataFrame | Cells,
    k: int,
    metric: str = "cosine",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    corpus_id: str = "vec_id",
    corpus_vec: str = "embedding",
    probes: int = 8,
    n_cells: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Approximate k nearest corpus rows of every query: those in the `probes` nearest cells.

    A query is copied to each block that holds a cell it visits. With as many probes as there are cells the result is exact, but `knn_topk` is
    the cheaper way to it.
    """
    _metric(metric)
    cells = corpus if isinstance(corpus, Cells) else build_cells(corpus, metric, corpus_id, corpus_vec, n_cells)
    out_corpus_id = corpus_id if corpus_id != query_id else f"neighbour_{corpus_id}"
    q = _side(queries, query_id, query_vec, "_qid")
    if not cells.sizes.any():
        q = q.limit(0)
    width = cells.centroids.shape[1]
    q_rows = block_rows or _block_rows(q.sparkSession, q.count(), width)
    c_rows = block_rows or _block_rows(q.sparkSession, int(cells.sizes.sum()), width)
    groups, types = _dealt(q, cells.rows, cells, probes, q_rows, c_rows)
    return _top(groups.applyInArrow(_block_scorer(k, cells.metric), types), k, cells.metric, query_id, out_corpus_id)
