"""Approximate nearest neighbours by learned partitions.

On a sample of at most `sample` vectors (those of the smallest hash of the id) the neighbour graph is made and cut into partitions of
nearly equal size with few edges between them. A small network learns to tell a vector's partition, from the partitions of its
neighbours. Every row of the table is then indexed in its most probable partition, and a query visits its most probable ones; how
many, is the least number that finds `recall` of the neighbours within the sample. What is found is ranked by its exact scores.

Equal vectors are asked once, and of equal vectors the `k + 1` smallest ids only can be among a query's first `k`, so no more of them
are scored. Of a partition, both its rows and the queries that visit it are cut into blocks of about `BLOCK` (fewer if vectors are long), and a
group is one block of either, so no group grows with the table. Queries are asked in rounds, each stored before the next: a round
shuffles about `ROUND_COPIES` times the table's rows, or `ROUND_ROWS` if that is more, however many queries there are.

Vectors that are null, zero or hold a null or a number that is not finite take no part, nor do rows without an id, nor vectors of another
length than most have (the longer, if two are as frequent). Equal rows are one candidate. Fewer candidates than `k` are all
returned; an empty table returns none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored

SAMPLE = 8192
NEIGHBOURS = 10
#: Rows of a partition, on average, and the most partitions that a sample is cut into, which has 32 vectors for each.
PARTITION_ROWS = 256
MOST_PARTITIONS = 256
BLOCK, BLOCK_BYTES = 16_384, 8 << 20
ROUND_ROWS, ROUND_COPIES = 4_000_000, 2
RECALL = 0.95
HIDDEN = 128


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The `k` most similar other rows of each row."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        scores = x[at : at + 512] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at : at + 512] = np.argpartition(-scores, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, count: int, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """A partition for each row: halves along principal directions, then moves that cut fewer edges and keep the sizes."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, count)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(order) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    back: list[list[int]] = [[] for _ in x]
    for i, near in enumerate(graph.tolist()):
        for j in near:
            back[j].append(i)
    ties = [np.array([*near, *b], np.int64) for near, b in zip(graph.tolist(), back, strict=True)]
    size = np.bincount(part, minlength=count)
    most, least = int(np.ceil(slack * len(x) / count)), int(len(x) / count / slack)
    for _ in range(sweeps):
        moved = 0
        for i, tied in enumerate(ties):
            if not len(tied):
                continue
            votes = np.bincount(part[tied], minlength=count)
            votes = np.where(size < most, votes, 0)
            best = int(votes.argmax())
            if votes[best] > (part[tied] == part[i]).sum() and size[part[i]] > least:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer, from unit vectors to log-odds of partitions."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.bias

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, the most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def train_router(x: np.ndarray, target: np.ndarray, rounds: int = 40, batch: int = 256, seed: int = 5) -> Router:
    """Minimises the cross entropy to target shares, by Adam in a fixed order."""
    rng = np.random.default_rng(seed)
    d, count = x.shape[1], target.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d) * np.sqrt(d) / 8, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, count)), np.zeros(count)]
    m, s = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(x))
        rate = 0.01 * (1 - turn / rounds) + 1e-4
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            e = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            b = (e @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ b, b.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit(vectors: np.ndarray, count: int, recall: float = RECALL) -> Router:
    """A router for `count` partitions; a fifth of the sample is kept apart to choose the number of probes."""
    x = unit(vectors)
    if count < 2 or len(x) < 10 * count:
        return Router(np.zeros((vectors.shape[1] if vectors.ndim == 2 else 1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_partitions(x, graph, count)
    target = np.zeros((len(x), count))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    for column in graph.T:
        np.add.at(target, (np.arange(len(x)), part[column]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    apart = np.arange(len(x)) % 5 == 0
    router = train_router(x[~apart], target[~apart])
    ranked = router.ranked(x)
    place = np.argsort(ranked, axis=1)  # place[row, partition]
    home = ranked[:, 0]
    rank = np.take_along_axis(place[apart], home[graph[apart][:, :5]], axis=1)
    found = np.array([(rank < n).mean() for n in range(1, count + 1)])
    router.probes = int(np.argmax(found >= recall)) + 1 if found.max() >= recall else count
    return router


def _usable(vector: Column) -> Column:
    """Not null nor zero, and all components finite numbers."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows have equal scores wherever they stand."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _search(k: int):
    def search(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(candidates) and len(queries):
            ids, rows = candidates["vec_id"].to_numpy(np.int64), _matrix(candidates["v"])
            scaled = unit(rows)
            step = max(1, (1 << 21) // len(rows))
            for at in range(0, len(queries), step):
                part = queries.iloc[at : at + step]
                asked = _matrix(part["v"])
                rough = unit(asked) @ scaled.T
                # The rough scores differ from the exact ones in the last places only.
                low = np.partition(rough, -min(k, rough.shape[1]), axis=1)[:, -min(k, rough.shape[1])] - 1e-9
                for number, query, near in zip(part["query"], asked, rough >= low[:, None], strict=True):
                    some = np.flatnonzero(near)
                    scores = exact_scores(query, rows[some])
                    best = np.lexsort((ids[some], -scores))[:k]
                    out += [(number, int(ids[some[b]]), float(scores[b])) for b in best]
        return pd.DataFrame(out, columns=["query", "vec_id", "score"])

    return search


def _each(rows: DataFrame, name: str, blocks: Column) -> DataFrame:
    """A copy of each row for each block of its partition."""
    n = F.get(blocks, F.col("part"))
    return rows.where(n > 0).withColumn(name, F.explode(F.sequence(F.lit(0), n - 1)))


def nearest(
    embeddings: DataFrame, asked: Column, k: int = 5, sample: int = SAMPLE, recall: float = RECALL, probes: int | None = None,
    partition_rows: int = PARTITION_ROWS, most_partitions: int = MOST_PARTITIONS,
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` for each row for which `asked` holds: its `k` nearest found other rows.

    With `probes` as many as there are partitions, the search is exact. There are as many partitions as give each `partition_rows` rows, but
    no more than `most_partitions` and one for 32 vectors of the sample; beyond that partitions grow, and with them their blocks.
    """
    usable = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), asked.alias("asked"))
    usable = usable.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    # Adding zero makes a negative zero positive, so that equal vectors are equal keys.
    usable = usable.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, total = (sizes["d"], sizes["count"]) if sizes else (0, 0)
    rows = usable.where(F.size("v") == d)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    count = int(min(most_partitions, -(-total // partition_rows), max(1, len(chosen) // 32)))
    router = fit(_matrix(chosen["v"]).reshape(len(chosen), d), count, recall)
    count = router.bias.size
    visits = min(count, probes or router.probes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                ranked = router.ranked(unit(v))[:, :visits].astype(np.int32)
                parts = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * visits, pa.array(ranked.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("asked"), parts], names=["vec_id", "v", "asked", "parts"])

    indexed = Stored(rows.distinct().mapInArrow(place, "vec_id long, v array<double>, asked boolean, parts array<int>"), "ann-index").df
    first = Window.partitionBy("v").orderBy("vec_id")
    candidates = indexed.select("v", "vec_id", F.get("parts", F.lit(0)).alias("part")).distinct().withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    candidates = Stored(candidates.select("v", "vec_id", "part"), "ann-candidates").df
    members = {r.part: r["count"] for r in candidates.groupBy("part").count().collect()}
    queries = Stored(indexed.where("asked").groupBy("v").agg(F.min("vec_id").alias("query"), F.first("parts").alias("parts")), "ann-queries").df
    visitors = {r.part: r["count"] for r in queries.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, d))))
    # Copies of queries, one for each block of rows, and of rows, one for each block of queries.
    copies = sum(n * -(-members.get(p, 0) // size) + members.get(p, 0) * n / size for p, n in visitors.items())
    rounds = max(1, math.ceil(copies / max(ROUND_ROWS, ROUND_COPIES * total)))
    # At most `most_partitions` numbers each.
    blocks = F.array(*[F.lit(-(-members.get(p, 0) // size)) for p in range(count)])
    query_blocks = F.array(*[F.lit(math.ceil(visitors.get(p, 0) / rounds / size)) for p in range(count)])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    tops = []
    for number in range(rounds):
        asking = queries.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == number)
        routed = _each(asking.select("query", "v", F.explode("parts").alias("part")), "block", blocks)
        routed = routed.withColumn("query_block", F.pmod(F.hash("query", "v"), F.get(query_blocks, F.col("part"))))
        dealt = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.get(blocks, F.col("part"))).cast("int"))
        groups = _each(dealt, "query_block", query_blocks).groupBy("part", "block", "query_block")
        found = groups.cogroup(routed.groupBy("part", "block", "query_block")).applyInPandas(_search(k + 1), "query long, vec_id long, score double")
        ranked = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
        tops.append(Stored(ranked.select("query", "vec_id", "score"), "ann-found"))
    top = embeddings.sparkSession.read.parquet(*[t.path for t in tops])
    # Back to every query: those of equal vectors share what was found, each without itself.
    asking = indexed.where("asked").select(F.col("vec_id").alias("query_id"), "v").distinct().join(queries.select("v", "query"), "v").select("query_id", "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asking.join(top, "query").where("vec_id != query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
