import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import shared_windows
from lodestone.llm.queries import QUERIES
from lodestone.llm.substring_dedup import Automaton, substring_dedup
from rows import clashing, frame, prose


def brute(texts, length):
    seen, out = set(), []
    for t in texts:
        words = (t or "").encode().split()
        gone, end = bytearray(len(words)), 0
        for s in range(len(words) - length + 1):
            w = tuple(words[s : s + length])
            if w in seen:
                gone[max(end, s) : s + length] = b"\1" * (s + length - max(end, s))
                end = s + length
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return [tuple(r) for r in df.orderBy("doc_id").select("n_words", "n_removed", "kept_sha256").collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=4), st.lists(st.integers(0, 2), max_size=30))
def test_matching_statistics(shards, words):
    automaton = Automaton()
    for s in shards:
        automaton.add(s)
    known = {tuple(s[i:j]) for s in shards for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    wanted = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in known), default=0) for i in range(len(words))]
    assert list(automaton.statistics(words)) == wanted


@pytest.mark.parametrize("block", [2, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shared_windows, "BLOCK", block)
    shared = prose(60, 1)
    near = [shared.replace(f" {w} ", " andres ", 1) for w in shared.split()[3:50:4]]
    twice = prose(12, 8)
    texts = [prose(5, 2) + " " + shared, shared + "\x0b\t " + prose(9, 3), None, "", "kurz", " ".join(["ha"] * 90), *near, f"{twice} {twice}  {twice}"]
    df = substring_dedup(clashing(frame(spark, texts)), length=10)
    assert found(df) == brute(texts, 10)
    last = df.orderBy("doc_id").collect()[-1]
    assert last.kept == twice and [tuple(s) for s in last.spans] == [(12, 36)]


def test_order_is_by_id_and_repeated_rows_are_one(spark):
    text = prose(30, 5)
    rows = substring_dedup(frame(spark, [text, text, text, text], ids=[9, 3, 3, None]), length=10).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in rows), key=repr) == sorted([(9, 30), (3, 30), (3, 30), (None, 0)], key=repr)


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [])).collect() == []


def test_query(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    assert found(QUERIES["op4_substring_dedup"](spark, data)) == brute(texts, 20)
