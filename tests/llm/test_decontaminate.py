import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontaminate as module
from lodestone.llm.decontaminate import MATCH, MISMATCH, SPACE, align, decontaminate, leaks
from lodestone.llm.queries import QUERIES
from rows import clashing, frame, prose, tuples


def benchmark(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts, strict=True)), "item_id long, text string")


def brute_score(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a == b else MISMATCH), h[i - 1][j] + SPACE, h[i][j - 1] + SPACE)
    return max(map(max, h))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_alignment(item, text):
    score, start, end = align(np.array(item, np.uint64), np.array(text, np.uint64))
    assert round(score * MATCH * len(item)) == brute_score(item, text)
    assert 0 <= start <= end <= len(text)
    if score:
        assert brute_score(item, text[start:end]) == brute_score(item, text)


def edited(text, every, offset=1):
    words = text.split()
    return " ".join(f"other{i}" if i % every == offset else w for i, w in enumerate(words))


@pytest.mark.parametrize("block_words", [30, 1_000_000])
def test_copies_and_edited_copies(spark, monkeypatch, block_words):
    monkeypatch.setattr(module, "BLOCK_WORDS", block_words)
    items = [prose(30, 100 + i) for i in range(5)]
    around = prose(80, 7)
    dropped = " ".join(w for i, w in enumerate(items[1].split()) if i % 6 != 2)
    texts = [
        f"{around} {items[0].upper()}. {around}", f"{around} {edited(items[1], 5)}", f"{dropped} {around}", items[2], around,
        f"{items[3]} {around} {items[3]}", " ".join(items[4].split()[:5]) + " " + around, None, "", "   ",
    ]
    found = leaks(clashing(frame(spark, texts)), benchmark(spark, items))
    assert tuples(found, "doc_id", "item_id") == [(0, 0), (1, 1), (2, 1), (3, 2), (5, 3), (5, 3)]
    first = found.where("doc_id = 0").first()
    assert (first.first_word, first.last_word, first.score) == (80, 109, 1.0)
    kept = decontaminate(clashing(frame(spark, texts)), benchmark(spark, items))
    assert tuples(kept, "doc_id") == [(4,), (6,), (7,), (8,), (9,)]
    assert kept.columns == clashing(frame(spark, texts)).columns


def test_an_item_that_leaked_everywhere_is_found_everywhere(spark):
    item = prose(25, 3)
    texts = [f"{prose(20, 500 + i)} {item}" for i in range(60)]
    assert len(leaks(frame(spark, texts), benchmark(spark, [item])).collect()) == 60


def test_edges(spark):
    item = prose(20, 1)
    docs = frame(spark, [item, item, item], ids=[None, 3, 3])
    assert tuples(leaks(docs, benchmark(spark, [item, item, None, "", "two others"], ids=[1, 2, 3, None, 5])), "doc_id", "item_id") == sorted(
        [(None, 1), (None, 2), (3, 1), (3, 2), (3, 1), (3, 2)], key=repr
    )
    assert leaks(frame(spark, []), benchmark(spark, [item])).collect() == []
    assert leaks(docs, benchmark(spark, [])).collect() == []
    assert decontaminate(docs, benchmark(spark, [])).count() == 3


def test_query_against_all_alignments(spark, data):
    """Every document against every item, wherever they share a word triple."""
    from lodestone.llm.plainwords import hashes

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    items = [(r.item_id, hashes(r.text.encode())) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    wanted = set()
    for r in docs:
        words = hashes((r.text or "").encode())
        for item_id, item in items:
            if np.isin(item, words).sum() >= 0.5 * len(item) and align(item, words)[0] >= 0.5:
                wanted.add((r.doc_id, item_id))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, data).collect()} == wanted


def changed(text, every, how):
    """Every so many words replaced, dropped or preceded by another."""
    at = [(w, i % every == every - 1) for i, w in enumerate(text.split())]
    return " ".join({"replaced": f"other{i}", "dropped": "", "preceded": f"other{i} {w}"}[how] if cut else w for i, (w, cut) in enumerate(at))


@pytest.mark.parametrize("beside", [0, 3])
def test_copies_with_evenly_spread_edits(spark, beside):
    """No three words of some stand together; exact copies elsewhere make the intact words the more frequent ones."""
    items = [prose(40, 900 + i) for i in range(4)]
    ways = [(every, how) for every in (3, 4, 5, 6) for how in ("replaced", "dropped", "preceded")]
    texts = [f"{prose(60, 30 + i)} {changed(items[i % 4], *way)} {prose(60, 60 + i)}" for i, way in enumerate(ways)]
    found = leaks(frame(spark, texts + items * beside), benchmark(spark, items)).where(f"doc_id < {len(ways)}")
    assert tuples(found, "doc_id", "item_id") == sorted([(i, i % 4) for i in range(len(ways))], key=repr)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_stretches_miss_no_alignment(data):
    """What the seeds lead to is what the whole text gives, with few words, in parts and whole."""
    from lodestone.llm.decontaminate import HITS, Items, Lookup, least_score
    from lodestone.llm.plainwords import hashes

    draw = lambda size: " ".join(f"w{n}" for n in data.draw(st.lists(st.integers(0, 9), min_size=1, max_size=size)))
    items, text = [draw(14) for _ in range(3)], draw(60)
    words = [hashes(i.encode()) for i in items]
    often = {w: text.split().count(w) for i in items for w in i.split()}
    try:
        module.HITS = data.draw(st.sampled_from([1, 7, HITS]))
        block = module._seeds(list(range(3)), words, Lookup(np.concatenate(words)), np.array(
            [n for _, n in sorted((int(hashes(w.encode())[0]), n) for w, n in often.items())]), 0.5)
        found = list(block.leaks(text.encode()))
    finally:
        module.HITS = HITS
    assert isinstance(block, Items)
    body = hashes(text.encode())
    whole = [x[1:] for x in block.aligned([(0, i, 0, len(body)) for i in range(3)], body, np.array([0, len(body)]))]
    assert sorted(found) == sorted(whole)
    for i, w in enumerate(words):
        assert any(f[0] == i for f in found) == (brute_score(w.tolist(), body.tolist()) >= least_score(len(w), 0.5))


def test_short_items_and_scripts_without_spaces(spark):
    """Items of one or two words stand as they are, and a Han character is a word, so copies between others are found, edited ones too."""
    han = "今天天气很好我们一起去公园散步然后回家吃饭看书睡觉"
    thai = "ภาษาไทยไม่มีช่องว่าง"
    items = ["general relativity", "photosynthesis", han, thai]
    texts = [
        "On general relativity, again", "general theory of relativity", "relativity general", "Photosynthesis.", "photosyntheses",
        f"他说{han}对吗", "他说" + han.replace("公园", "学校") + "对吗", "他说天气不好", f"ก{thai}ข", "general  RELATIVITY",
    ]
    found = leaks(frame(spark, texts), benchmark(spark, items))
    assert tuples(found, "doc_id", "item_id") == [(0, 0), (3, 1), (5, 2), (6, 2), (8, 3), (9, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab C.é漢字ไ😀\n", max_size=30), max_size=12), st.booleans())
def test_bodies_hashed_together_are_those_hashed_alone(texts, unspaced):
    from lodestone.llm.plainwords import hashes, hashes_of_all

    bodies = [t.encode() for t in texts]
    found, begins = hashes_of_all(bodies, unspaced)
    for i, body in enumerate(bodies):
        assert found[begins[i] : begins[i + 1]].tolist() == hashes(body, unspaced).tolist()


def test_texts_searched_together_are_those_searched_alone():
    from lodestone.llm.decontaminate import Lookup
    from lodestone.llm.plainwords import hashes

    items = [prose(20, i, 60) for i in range(6)]
    words = [hashes(i.encode()) for i in items]
    every = Lookup(np.concatenate(words))
    block = module._seeds(list(range(6)), words, every, np.ones(len(every.values), np.int64), 0.5)
    bodies = [f"{prose(n, 70 + n, 60)} {items[n % 6] if n % 3 else ''} {prose(n, 7, 60)}".encode() for n in range(40)]
    together = sorted(block.leaks_of_all(bodies))
    assert together == sorted((i, *leak) for i, body in enumerate(bodies) for leak in block.leaks(body)) and together
