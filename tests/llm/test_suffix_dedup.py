import hashlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import shared_windows
from lodestone.llm.queries import QUERIES
from lodestone.llm.suffix_dedup import previous_factors, suffix_dedup, suffix_ranks
from rows import clashing, frame, prose


def brute(texts, length, keep):
    bodies = [(t or "").encode() for t in texts]
    count, seen, out = Counter(), set(), []
    for b in bodies:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for b in bodies:
        gone, end = bytearray(len(b)), 0
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if count[w] > 1 and (keep == "none" or w in seen):
                gone[max(end, s) : s + length] = b"\1" * (s + length - max(end, s))
                end = s + length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def found(df):
    return [tuple(r) for r in df.orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def test_ranks_are_suffix_order():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    for length in (1, 5, 8, 13, 16, 50):
        at = np.arange(len(text) - length + 1)
        order = {s: i for i, s in enumerate(sorted({text[i : i + length].tobytes() for i in at}), 1)}
        assert suffix_ranks(text, length, at).tolist() == [order[text[i : i + length].tobytes()] for i in at]


def test_previous_factors():
    rank = np.array([2, 1, 2, 3, 1, 2], np.uint64)
    earlier, later, counts = previous_factors(rank)
    assert earlier.tolist() == [False, False, True, False, True, True]
    assert later.tolist() == [True, True, True, False, False, False]
    assert counts.tolist() == [3, 2, 0, 1, 0, 0]


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_against_brute_force(spark, monkeypatch, block, keep):
    monkeypatch.setattr(shared_windows, "BLOCK", block)
    shared = prose(40, 1)
    near = [shared.replace(f" {w} ", " ÄNDERUNG ", 1) for w in shared.split()[3:30:3]]
    texts = [shared, "x " + shared, prose(30, 2) + shared[20:150] + prose(9, 3), None, "", "kurz", "ab" * 200, *near, prose(50, 4)]
    df = suffix_dedup(clashing(frame(spark, texts)), length=40, keep=keep)
    assert found(df) == brute(texts, 40, keep)
    row = df.where("doc_id = 1").first()
    body = texts[1].encode()
    cut = set().union(*(range(s.s, s.e) for s in row.spans)) if row.spans else set()
    assert bytes(row.kept) == bytes(c for i, c in enumerate(body) if i not in cut)


def test_repeated_rows_and_missing_ids(spark):
    text = prose(30, 5)
    df = suffix_dedup(frame(spark, [text, text, "a", prose(30, 6)], ids=[7, 7, None, None]), length=50)
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in df.collect()), key=repr)
    assert rows == sorted([(7, len(text), len(text))] * 2 + [(None, 1, 0), (None, len(prose(30, 6)), 0)], key=repr)


def test_empty_table(spark):
    assert suffix_dedup(frame(spark, [])).collect() == []


def test_query(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    assert found(QUERIES["op3_suffix_dedup"](spark, data)) == brute(texts, 400, "none")
