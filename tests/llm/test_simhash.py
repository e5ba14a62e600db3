import random

import pytest
from xxhash import xxh64_intdigest

from lodestone.llm import simhash
from lodestone.llm.components import connected_components
from lodestone.llm.queries import QUERIES
from lodestone.llm.simhash import fingerprint, links, masks, simhash_components, simhash_dedup
from rows import clashing, frame, prose, tuples


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(nodes, close):
    """The least node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(texts):
    fps = [brute_fingerprint(t) for t in texts]
    to = groups(list(range(len(texts))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    return [(i, f"{fps[i]:016x}", to[i]) for i in range(len(texts))]


def test_fingerprint_over_several_parts(monkeypatch):
    text = prose(200, 1) + " Ä É A"
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    assert fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_last_cut_bounds_a_bucket():
    for level, paths in enumerate(masks()):
        assert len(paths) == 10 ** (level + 1)
    assert min((m & (2**64 - 1)).bit_count() for m in masks()[-1]) >= 64 - 15


@pytest.mark.parametrize("bucket", [1, 4, 1024])
def test_links_connect_what_is_close(spark, monkeypatch, bucket):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(25)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    found = links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, bucket)
    rows = [tuple(r) for r in found.collect()]
    linked = set(rows)
    assert groups(signed, lambda a, b: (a, b) in linked or (b, a) in linked) == groups(signed, close)
    assert len(linked) <= 10**3 * len(signed)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    linked = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    wanted = groups(nodes, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == wanted
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_against_brute_force(spark):
    base = prose(400, 1)
    texts = [base, base.upper(), base.replace("w1", "v1", 1), prose(300, 2), None, "", " \t", "one", "ONE", "one two", prose(50, 3), base + " end"]
    assert tuples(simhash_components(clashing(frame(spark, texts))), "doc_id", "fingerprint", "component_id") == sorted(brute(texts), key=repr)


def test_repeated_rows_and_missing_ids(spark):
    a, b = prose(40, 1), prose(40, 2)
    df = frame(spark, [a, a, a, b, b], ids=[4, 4, None, None, None])
    assert tuples(simhash_components(df), "doc_id", "component_id") == sorted([(4, 4), (4, 4), (None, 4), (None, None), (None, None)], key=repr)
    assert tuples(simhash_dedup(df), "doc_id", "text") == sorted([(4, a), (None, b)], key=repr)


def test_dedup_keeps_one_of_each_group(spark):
    texts = [prose(300, 1), prose(300, 1), prose(300, 2), None, ""]
    df = clashing(frame(spark, texts))
    out = simhash_dedup(df)
    assert out.columns == df.columns
    assert tuples(out, "doc_id") == [(0,), (2,), (3,)]


def test_empty_table(spark):
    assert simhash_components(frame(spark, [])).collect() == []
    assert simhash_dedup(frame(spark, [])).collect() == []


def test_query(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    assert tuples(QUERIES["op2_simhash_dedup"](spark, data), "doc_id", "fingerprint", "component_id") == sorted(brute(texts), key=repr)
