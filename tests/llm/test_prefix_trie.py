from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import radix
from lodestone.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def trie(rows):
    """Every node of the trie, from a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {conv: [t for _, t in sorted(found)] for conv, found in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, found in turns.items():
        shared = zlib.crc32(str(conv).encode()) % 9
        way = (*turns.get(conv - conv % 5, [])[:shared], *found[shared:])
        ends[way].append(conv)
        for depth in range(len(way) + 1):
            members[way[:depth]].append(conv)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for way in members:
        if way:
            children[way[:-1]] += 1
    for way, convs in members.items():
        for depth in range(len(way) + 1):
            leaves[way[:depth]] += not children[way]
            saved[way[:depth]] += (len(convs) - 1) * len(way[-1][1].encode()) if way else 0
    return sorted(
        ((min(convs), len(way), min(members[way[:-1]]) if way else None, len(convs), children[way], leaves[way], saved[way],
          hashlib.sha256(",".join(map(str, sorted(ends[way]))).encode()).hexdigest()) for way, convs in members.items()), key=str
    )


def odd_rows():
    rng = random.Random(4)
    rows = [
        (conv, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "é", None]))
        for conv in [None, *range(-13, 60)] for t in range(rng.randrange(14))
    ]
    # Copies of a long conversation, one that is its beginning, one alone in its family, and equal rows.
    for conv in (200, 201, 202, 203, 204, 777):
        rows += [(conv, i, "u", f"x{i % 3}") for i in range(49 if conv == 201 else 50)]
    return rows + [(300, 1, "u", "same")] * 40 + [(400, 0, "u", "y" * 100_000)]


def assert_trie(df, **settings):
    expected = trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(map(tuple, prefix_trie(df, **settings).collect()), key=str) == expected


@pytest.mark.parametrize("settings", [{}, {"turns": 1, "held": 30, "listed": 1}])
def test_odd_conversations(spark, settings):
    assert_trie(spark.createDataFrame(odd_rows(), SCHEMA).repartition(3), **settings)


def test_given_conversations(spark, data):
    assert_trie(spark.read.parquet(f"{data}/conversations.parquet"))


def test_a_third_of_all_is_one_conversation_or_one_first_turn(spark):
    rows = [(5, i, "user", f"t{i % 50}") for i in range(300)] + [(c, 0, "system", "Be kind.") for c in range(1000, 1300)]
    assert_trie(spark.createDataFrame(rows, SCHEMA), turns=64, listed=100)


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(odd_rows()[:200], SCHEMA)
    for name in ("id", "size", "salt", "part", "seq", "key", "parent", "depth", "head", "last", "family", "start"):
        df = df.withColumn(name, F.lit("x"))
    assert_trie(df)


def test_layouts_grow_and_prefixes_split():
    tree, rng = radix.Tree(), random.Random(2)
    keys = {bytes([i]) + bytes(15) for i in range(256)} | {bytes(16) + rng.randbytes(32) for _ in range(300)}
    keys |= {bytes(16), b"", bytes(15) + b"\x01" + bytes(16)}
    layouts = set()
    for n, key in enumerate(sorted(keys, key=lambda k: zlib.crc32(k))):
        tree.add(key, 1, n, 0, n)
        layouts.add((type(tree.root.kids).__name__, getattr(tree.root.kids, "most", 0)))
    assert layouts == {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Full", 0)}
    expected = {k[:d] for k in keys for d in range(0, len(k) + 1, 16)}
    found, nodes, more = {}, tree.nodes(), None
    while True:
        try:
            path, node, count, least, tail = nodes.send(more)
        except StopIteration:
            break
        assert path not in found
        found[path], more = (count, tail), 1
        assert (node is not None and bool(node.marks)) == (path in keys)
    assert set(found) == expected
    assert all(found[p][0] == sum(k.startswith(p) for k in keys) for p in expected)
    assert found[b""][1] == len(expected) - 1
