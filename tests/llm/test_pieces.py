from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm.rows import clashing, frame
from sentencepiece import SentencePieceProcessor

from lodestone.llm import pieces as module
from lodestone.llm.pieces import Pieces, decode_ids, encode_and_decode, piece_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "aa", " ", "  ", "▁", "\n", "the", "é", "漢", "😀", "\0", "0", ".", "<s>", "<0x41>", "x" * 9, "ing", " th", "er", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(module._read(MODEL))


def texts():
    rng = random.Random(1)
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    some += [" " * n for n in range(40)] + ["aaaa" * n for n in range(30)]
    # Very long words, and stretches of white space.
    return [*some, "a" * 5000, " " * 700, "ab " * 3000, "".join(chr(rng.randrange(97, 123)) for _ in range(20000)), "漢字" * 2000]


def test_ids_and_texts_are_the_library_s(pieces, library):
    some = texts()
    ids = pieces.encode(some)
    expected = [library.encode(t, add_bos=True, add_eos=True) for t in some]
    assert [i.tolist() for i in ids] == expected
    assert pieces.decode(ids) == [library.decode(e).encode() for e in expected]


def test_parts_of_long_texts_join_exactly(pieces, library, monkeypatch):
    monkeypatch.setattr(module, "PART", 50)
    some = texts()[:300] + ["x" * 400 + " y"]
    assert [i.tolist() for i in pieces.encode(some)] == [library.encode(t, add_bos=True, add_eos=True) for t in some]


def test_any_ids_decode_as_the_library_does(pieces, library):
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 300 if rng.random() < 0.7 else 32000, rng.integers(0, 12)).tolist() for _ in range(3000)]
    assert pieces.decode([np.array(r, np.int64) for r in rows]) == [library.decode(r).encode() for r in rows]


def digests(library, rows):
    found = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids).encode()
        found.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return sorted(found, key=str)


def test_given_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert sorted(map(tuple, piece_digests(docs, MODEL).collect()), key=str) == digests(library, docs.select("doc_id", "text").collect())


def test_nulls_ties_repeats_and_clashing_columns(spark, library):
    df = frame(spark, [None, "", "Hi there", "Hi there", "x " * 50_000, "é\0"], ids=[None, 1, 2, 2, 3, None])
    for name in ("ids", "decoded", "n_tokens"):
        df = df.withColumn(name, df["lang"])
    found = sorted(map(tuple, piece_digests(clashing(df), MODEL).collect()), key=str)
    assert found == digests(library, df.select("doc_id", "text").collect())
    assert piece_digests(df.limit(0), MODEL).collect() == []


def test_ids_of_a_table_decode(spark, library):
    rows = [(1, [1, 12014, 2]), (2, None), (3, [])]
    found = {r.doc_id: bytes(r.decoded).decode() for r in decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL).collect()}
    assert found == {1: library.decode([1, 12014, 2]), 2: "", 3: ""}
    (row,) = encode_and_decode(frame(spark, ["Hi"]), MODEL, decoded=False).collect()
    assert row.decoded is None and np.frombuffer(row.ids, "<u4").tolist() == library.encode("Hi", add_bos=True, add_eos=True)


def test_other_kinds_of_models_are_refused():
    with pytest.raises((ValueError, RuntimeError)):
        Pieces(b"\x0a\x00")
