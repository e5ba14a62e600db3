import math
from collections import Counter, defaultdict

import pytest

from lodestone.llm import mixing
from lodestone.llm.mixing import exponent, mixing_counts, mixing_sql, mixture
from rows import clashing, frame, prose, tuples


def corpus(spark):
    texts, sources = [], []
    for source, n in (("big", 90), ("mid", 30), ("small", 6), (None, 12)):
        for i in range(n):
            texts.append(prose(5 + i % 7, len(texts)))
            sources.append(source)
    return frame(spark, [*texts, None, "", "lost"], [*sources, "big", "small", "one"])


def words_by_source(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += r.n_tokens * r.copies
    return out


def test_weights_reach_the_entropy_and_the_budget(spark):
    df = corpus(spark)
    rows = mixing_counts(df, entropy=0.9, repeats=1000.0).collect()
    own = Counter()
    for r in rows:
        own[r.source] += r.n_tokens
    total, mixed = sum(own.values()), words_by_source(rows)
    longest = max(r.n_tokens for r in rows)
    assert total - len(own) * (longest + 1) <= sum(mixed.values()) <= total
    shares = [v / sum(mixed.values()) for v in mixed.values()]
    assert abs(-sum(s * math.log(s) for s in shares) / math.log(len(own)) - 0.9) < 0.02
    assert all(max(c) - min(c) <= 1 for s in own if (c := [r.copies for r in rows if r.source == s and r.n_tokens]))


def test_limit_of_repetition_wins(spark):
    rows = mixing_counts(corpus(spark), entropy=1.0, repeats=1.5).collect()
    assert max(r.copies for r in rows) == 2
    own = Counter()
    for r in rows:
        own[r.source] += r.n_tokens
    assert all(v <= 1.5 * own[s] + 1e-6 for s, v in words_by_source(rows).items())


@pytest.mark.parametrize("repeats", [2.0, 100.0])
def test_exponent_against_scan(spark, repeats):
    shares = [0.6, 0.25, 0.1, 0.05]

    def at(step):
        q = [s ** (step / mixing.STEPS) for s in shares]
        z = sum(q)
        return -sum(x / z * math.log(x / z) for x in q), max(x / z / s for x, s in zip(q, shares, strict=True))

    def first(holds):
        low, high = -1, mixing.STEPS + 1
        while high - low > 1:
            m = (low + high) // 2
            low, high = (m, high) if holds(*at(m)) else (low, m)
        return low

    wanted = max(0, first(lambda h, r: h >= 0.95 * math.log(4)), min(mixing.STEPS, first(lambda h, r: r > repeats) + 1))
    got = exponent(spark.createDataFrame([(s,) for s in shares], "share double"), 0.95, repeats)
    assert round(got * mixing.STEPS) == wanted


@pytest.mark.parametrize("blocks", [2, 4096])
def test_against_sql(spark, monkeypatch, tmp_path, blocks):
    import duckdb

    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = sorted(con.execute(mixing_sql(0.95, 4.0)).fetchall(), key=repr)
    assert tuples(mixing_counts(corpus(spark), 0.95, 4.0), "doc_id", "source", "n_tokens", "copies") == wanted


def test_mixture_repeats_rows(spark):
    df = clashing(corpus(spark))
    counts = {r.doc_id: r.copies for r in mixing_counts(df, 0.95, 4.0).collect()}
    out = mixture(df, 0.95, 4.0)
    assert out.columns == [*df.columns, "mix_epoch", "mix_turn", "mix_place"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter({k: v for k, v in counts.items() if v})
    # Blocks stay together, and are in another order in each epoch.
    orders = defaultdict(dict)
    for r in got:
        if r.source == "small":
            orders[r.mix_epoch][r.mix_turn] = r.mix_place
    assert len(orders) > 1 and list(dict(sorted(orders[0].items())).values()) != list(dict(sorted(orders[1].items())).values())
    assert mixture(df, order=False).columns == df.columns


def test_repeated_rows_and_missing_ids(spark):
    df = frame(spark, ["a b", "a b", "c", "d e f", None], sources=["x"] * 5, ids=[1, 1, 1, None, None])
    assert tuples(mixture(df, order=False), "doc_id", "text") == sorted([(1, "a b"), (1, "a b"), (1, "c"), (None, "d e f"), (None, None)], key=repr)


def test_empty_tables(spark):
    assert mixture(frame(spark, [])).collect() == []
    assert sorted(r.doc_id for r in mixture(frame(spark, [None, ""])).collect()) == [0, 1]


def test_sources_without_words_are_taken_once(spark):
    docs = frame(spark, ["a b c", "", None, "", "d e"], ["x", "y", "y", "x", None])
    assert sorted((r.doc_id, r.copies) for r in mixing_counts(docs).collect() if r.source == "y") == [(1, 1), (2, 1)]
    assert sorted(r.doc_id for r in mixture(docs).where("source = 'y'").collect()) == [1, 2]
    assert mixing_counts(docs).count() == 5
    assert mixing_counts(frame(spark, [])).collect() == []
