from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import viterbi
from lodestone.llm.repair import RESULT, damaged, repair, repair_damaged

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAMES = {"u": "user", "a": "assistant"}


def faulty(rows):
    """The damaged rows of each conversation, in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        if fault:
            kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for rows in found.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return found


def inserted(paths):
    for _ in range(4):
        for state, (cost, audit, lines) in list(paths.items()):
            for initial, name in NAMES.items():
                to = NEXT.get((state, initial))
                new = (cost + 2, audit + "I", (*lines, name + ":"))
                if to and (to not in paths or new[:2] < paths[to][:2]):
                    paths[to] = new
    return paths


def cheapest(rows):
    """All of a conversation's result, by the least (cost, audit) to each state after each row."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    paths = inserted({"": (0, "", ())})
    for (_, role, text), fault, initial in zip(rows, faults, initials, strict=True):
        new = {}
        for state, (cost, audit, lines) in paths.items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("b", "d"):
                cost += fault == "t"
                options.append((NEXT.get((state, initial)), (cost, audit + "K", (*lines, f"{role}:{text}"))))
                options += [(NEXT.get((state, i)), (cost + 2, audit + "R", (*lines, f"{n}:{text}"))) for i, n in NAMES.items()]
            for to, path in options:
                if to is not None and (to not in new or path[:2] < new[to][:2]):
                    new[to] = path
        paths = inserted(new)
    cost, audit, lines = min((paths[s] for s in ("", "a") if s in paths), key=lambda p: p[:2])
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def odd_rows():
    rng = random.Random(4)
    texts = ["", " ", "a.", "b", "c!  ", "d?\n", "Hi .x", "\x0b", "é.", None, *(f"t{i}." for i in range(12))]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "uncle"]
    rows = [
        (conv, rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts))
        for conv in [None, *range(-3, 30)] for _ in range(rng.randrange(30))
    ]
    rows += [(7, 3, "user", "same.")] * 50 + [(100, i, "user", f"x{i}.") for i in range(60)] + [(102, 0, "user", "y" * 100_000)]
    # A conversation all of whose rows are dropped, and one of one row.
    lost = next(c for c in range(200, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "Gone."), (101, 0, "user", "")]


def assert_cheapest(df, **settings):
    expected = {conv: cheapest(rows) for conv, rows in faulty([tuple(r) for r in df.collect()]).items()}
    found = {r[0]: tuple(r)[1:] for r in repair(damaged(df), **settings).collect()}
    assert found == expected


@pytest.mark.parametrize("settings", [{}, {"turns": 7, "together": 5}, {"size": 3}])
def test_odd_conversations_whole_and_in_stretches(spark, settings):
    assert_cheapest(spark.createDataFrame(odd_rows(), SCHEMA), **settings)


def test_given_conversations(spark, data):
    assert_cheapest(spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def test_one_conversation_over_all_ranges(spark):
    rows = [(1, i, random.Random(i).choice(["user", "assistant", "user"]), f"{i}.") for i in range(3000)]
    assert_cheapest(spark.createDataFrame(rows, SCHEMA).repartition(4), turns=64)


def test_empty_table_and_clashing_columns(spark):
    empty = repair_damaged(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == [f.split()[0] for f in RESULT.split(", ")]
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    more = df
    for name in ("did", "hash", "kind", "code", "initial", "part", "seq", "audit", "whole", "first"):
        more = more.withColumn(name, F.lit("x"))
    assert sorted(map(str, repair_damaged(more).collect())) == sorted(map(str, repair_damaged(df).collect()))


def test_the_rows_given_may_be_repaired_as_they_are(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Well")]
    (row,) = repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (row.duplicate, row.truncated, row.illegal, row.cost, row.audit) == (1, 1, 1, 4, "KDK")


def test_vectors_reached_are_few_and_fronts_hold_for_all():
    """There is a bound on fix-up passes: the vectors that the steps make of the last one."""
    seen, todo = {viterbi.packed(viterbi.TERMINAL)}, [viterbi.TERMINAL]
    while todo:
        vector = todo.pop()
        for step in viterbi.STEPS[: viterbi.GONE + 1]:
            new = viterbi.normal((step + vector).min(axis=1))
            if viterbi.packed(new) not in seen:
                seen.add(viterbi.packed(new))
                todo.append(new)
    assert len(seen) <= 16
    codes = np.random.default_rng(1).integers(0, viterbi.GONE + 1, (40, 50)).astype(np.uint8)
    guesses = np.array([viterbi.unpacked(v) for v in sorted(seen)])
    found = viterbi.fronts(codes, guesses)
    for i, guess in enumerate(guesses):
        alone = viterbi.backward(codes, np.ones(codes.shape, np.int64), np.tile(guess, (40, 1)))[0]
        assert np.array_equal(viterbi.normal(alone), found[:, i])
