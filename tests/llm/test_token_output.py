import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import simple8b
from lodestone.llm.queries import QUERIES
from lodestone.llm.simple8b import BLOCK_IDS, END, LAYOUTS, Shard, ShardWriter, decode, encode
from lodestone.llm.token_output import Encoder, encoder, read_tokens, write_tokens
from rows import clashing, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def same(one, other, bodies):
    return [x.tolist() for x in one.encode(bodies)] == [x.tolist() for x in other.encode(bodies)]


def direct(texts):
    """(start, n, crc) of texts that are encoded whole."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False):
        ids = np.array([*e.ids, 1], "<u4")
        out.append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_layouts_fill_a_word():
    assert all(50 <= count * width <= 60 for count, width in LAYOUTS) and len(LAYOUTS) == 14


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 63).flatmap(lambda b: st.integers(0, (1 << b) - 1) | st.just((1 << 64) - 1)), max_size=300))
def test_round_trip(ids):
    values = np.array(ids, np.uint64)
    words, blocks = encode(values)
    assert decode(words).tolist() == ids
    assert len(blocks) == -(-len(ids) // BLOCK_IDS) + 1 and blocks[-1] == len(words)


def test_small_ids_share_words():
    assert len(encode(np.ones(600, np.uint64))[0]) == 10
    assert len(encode(np.full(600, 49_000, np.uint64))[0]) == 200


def test_shard_and_blocks(monkeypatch):
    monkeypatch.setattr(ShardWriter, "FLUSH", 2 * BLOCK_IDS)
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 700, 5000, 3, 1024, 2048)]
    writer = ShardWriter()
    for i, ids in enumerate(documents):
        writer.add(i, -i, ids)
    data = writer.close() + END
    shard = Shard.parse(data)
    assert shard.did.tolist() == list(range(7)) and shard.rk.tolist() == [-i for i in range(7)]
    for i, ids in enumerate(documents):
        assert shard.ids(int(shard.first[i]), int(shard.first[i + 1])).tolist() == ids.tolist()
    for broken in (data[:-1], data[:-9] + END, b"x" + data[1:]):
        with pytest.raises(ValueError):
            Shard.parse(broken)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB é́ßŞİΣς.,!'sS§K \n\t\x0b\x1c  　<|endoftext|>9½#_漢"), max_size=40))
def test_words_are_encoded_as_in_whole_texts(text):
    bodies = [text.encode(), b"A, b."]
    assert same(encoder(PATH), encoder(PATH, False), bodies)


def test_files(spark, tmp_path):
    texts = ["Two words", None, "", "  ", prose(700, 1), "<|endoftext|> Ä", *(prose(30, i) for i in range(60))]
    path = str(tmp_path / "shards")
    write_tokens(clashing(frame(spark, texts)), path, PATH, shard_ids=500)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) > 3
    for f in files:
        with open(os.path.join(path, f), "rb") as file:
            Shard.parse(file.read())
    rows = read_tokens(spark, path).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in rows] == direct(texts)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    path = str(tmp_path / "shards")
    write_tokens(frame(spark, ["b c", "a", "a", None], ids=[5, 2, 2, None]), path, PATH)
    rows = sorted(((r.doc_id, r.start, r.n_tokens) for r in read_tokens(spark, path, with_ids=False).collect()), key=lambda r: r[1])
    assert rows == [(None, 0, 1), (2, 1, 2), (2, 3, 2), (5, 5, 3)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "shards")
    write_tokens(frame(spark, []), path, PATH)
    assert read_tokens(spark, path).collect() == []


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr("lodestone.llm.token_output.REMEMBERED", 30)
    words, whole = Encoder(PATH, True), Encoder(PATH, False)
    for i in range(40):
        bodies = [prose(20, i, 60).encode(), b"", b"w1. <|endoftext|> W2,"]
        assert same(words, whole, bodies)
        assert len(words.known) <= 30 and len(words.first) == len(words.size) == len(words.used) == len(words.known)


def test_rules_of_the_tokenizer_are_known():
    encoder = Encoder(PATH, True)
    assert encoder.plain
    encoder.plain = False
    assert same(encoder, Encoder(PATH, True), [b"One, two-three 4.5 \xc3\xa9"])


def test_every_low_character():
    words = [f"a{chr(i)}b {chr(i)}".encode() for i in range(0x260)]
    assert same(Encoder(PATH, True), Encoder(PATH, False), words)


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr("lodestone.llm.token_output.AT_ONCE_BYTES", 64)
    bodies = [prose(100, 1).encode(), b"x" * 500, b"\n" + b"y" * 100 + b" z" * 60]
    assert same(Encoder(PATH, True), Encoder(PATH, False), bodies)


def test_query(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    rows = QUERIES["op6_token_output"](spark, data).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in rows] == direct(texts)
    assert simple8b.MAGIC[:4] == b"LDST"
