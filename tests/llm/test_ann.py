import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import ann
from lodestone.llm.ann import balanced_partitions, nearest, neighbour_graph, unit
from lodestone.llm.queries import QUERIES


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, k=5, every=50):
    """Ranked by score and id, from the vectors that take part."""
    part = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = set()
    for q, a in part.items():
        if q % every == 0:
            scored = [(-float(ann.exact_scores(a, b[None, :])[0]), i) for i, b in part.items() if i != q and len(b) == len(a)]
            out |= {(q, n, i, round(-s, 12)) for n, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def rows_of(df):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect()}


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return (centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)


def test_partitions_are_balanced_and_cut_few_edges():
    x = unit(vectors(1200, 16, 1).astype(float))
    graph = neighbour_graph(x, 10)
    assert all(i not in near for i, near in enumerate(graph.tolist()))
    part = balanced_partitions(x, graph, 6)
    size = np.bincount(part, minlength=6)
    assert size.max() <= np.ceil(1.1 * 200) and size.min() >= 180
    assert (part[graph] == part[:, None]).mean() > 0.8


def test_recall_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(3000, 16, 2))]
    wanted = {(q, i) for q, _, i, _ in brute(rows)}
    some = nearest(table(spark, rows), F.col("vec_id") % 50 == 0, sample=1500, partition_rows=250)
    assert len({(q, i) for q, _, i, _ in rows_of(some)} & wanted) / len(wanted) >= 0.9
    one = nearest(table(spark, rows), F.col("vec_id") % 50 == 0, sample=1500, probes=1, partition_rows=250)
    assert 0.3 < len({(q, i) for q, _, i, _ in rows_of(one)} & wanted) / len(wanted)
    every = nearest(table(spark, rows), F.col("vec_id") % 50 == 0, sample=1500, probes=99, partition_rows=250)
    assert rows_of(every) == brute(rows)


def test_copies_ties_and_vectors_that_take_no_part(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(0, 160, 10)] + [(1, [2.0, 4.0, 4.0]), (2, [-0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (100, [0.0, 1.0, 0.0])]
    odd = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 1.0]), (204, [1.0, float("nan"), 1.0]), (250, [float("inf"), 1.0, 1.0])]
    rows = [r for r in rows if r != (100, same)]
    df = table(spark, [*rows, *odd, (300, [1.0, 1.0]), (None, same), (10, same)]).withColumn("part", F.lit("x")).withColumn("score", F.lit(1))
    assert rows_of(nearest(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [0.0, 1.0])]
    assert rows_of(nearest(table(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows)
    assert nearest(table(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(table(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_query_learns_several_partitions(spark, data, monkeypatch):
    """The registered query's own path, on every given table: more than one partition, and not all of them visited on a larger one."""
    made = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    QUERIES["op5_learned_partitions"](spark, data)
    assert made[0].bias.size > 1


def test_clashing_columns(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(200, 8, 3))]
    df = table(spark, rows)
    for name in ("parts", "query", "v", "part", "copy", "asked", "block", "query_block"):
        df = df.withColumn(name, F.lit("x"))
    assert rows_of(nearest(df, F.col("vec_id") % 50 == 0, probes=99)) == brute(rows)


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    wanted, got = brute(rows), rows_of(QUERIES["op5_learned_partitions"](spark, data))
    assert len(got) == len(wanted) and len({r[::2] for r in got} & {r[::2] for r in wanted}) / len(wanted) >= 0.9


def test_groups_are_bounded_on_both_sides(spark, monkeypatch):
    """Every partition is visited by every query, over several rounds; a third of the rows are near to each other."""
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "ROUND_ROWS", 1, raising=False)
    search = ann._search

    def bounded(k):
        inner = search(k)

        def checked(key, candidates, queries):
            assert len(candidates) <= 160 and len(queries) <= 160
            return inner(key, candidates, queries)

        return checked

    monkeypatch.setattr(ann, "_search", bounded)
    x = vectors(3000, 16, 6)
    x[::3] = x[0] + 0.01 * np.random.default_rng(7).normal(size=(1000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert rows_of(nearest(table(spark, rows), F.col("vec_id") % 10 == 0, sample=1500, probes=99, partition_rows=500)) == brute(rows, every=10)
