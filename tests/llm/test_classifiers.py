import zlib

import numpy as np
import pytest

from lodestone.llm import quality, toxicity
from lodestone.llm.quality import best_quantile, fit_pairs, quality_filter
from lodestone.llm.queries import QUERIES
from rows import clashing, frame, prose

BIG = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_pairwise_fit_orders_by_the_hidden_score():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    hidden = x @ np.array([2.0, -1.0, 0.0, 0.5])
    i, j = rng.integers(2000, size=(2, 20_000))
    first = rng.random(20_000) < 1 / (1 + np.exp(hidden[j] - hidden[i]))
    better, worse = np.where(first, i, j), np.where(first, j, i)
    assert np.abs(fit_pairs(x[better], x[worse]) - [2.0, -1.0, 0.0, 0.5]).max() < 0.1


def test_quantile_parts_the_labels():
    raw, label = np.arange(10.0), np.array([0, 0, 0, 1, 1, 1, 1, 1, 1, 1])
    assert best_quantile(raw, label) == 0.3


def test_every_label_and_every_pair_is_learnt(spark):
    """21,000 rows and 251,880 pairs: the weights are those of the loss over all pairs, the cut that of all scores."""
    rng = np.random.default_rng(5)
    ids = np.array([i for i in range(30_000) if not held_out(i)][:21_000])
    label = np.ones(len(ids), int)
    label[rng.choice(len(ids), 12, replace=False)] = 0
    x = rng.normal(size=(len(ids), quality.FEATURES)) + 0.4 * label[:, None] * rng.normal(size=quality.FEATURES)
    rows = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "doc_id long, x array<double>").repartition(5)
    model = quality.train(rows, labels(spark, [(i, q, 0) for i, q in zip(ids.tolist(), label.tolist())]))
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    good, bad = z[label == 1], z[label == 0]
    assert np.abs(model.weights - fit_pairs(np.repeat(good, len(bad), axis=0), np.tile(bad, (len(good), 1)))).max() < 1e-9
    raw = np.sort(model.raw(x))
    at = round(best_quantile(model.raw(x), label) * len(raw))
    assert abs(model.cut - (raw[at - 1] + raw[at]) / 2) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_cut_over_ranges_of_scores(spark, seed):
    """Against `best_quantile`, with ties, several best cuts, and the best one at either end of a range or of all."""
    rng = np.random.default_rng(seed)
    raw, label = rng.integers(0, 9, 60).astype(float), rng.integers(0, 2, 60)
    if seed == 2:
        raw, label = np.arange(8.0), np.array([1, 1, 0, 0, 1, 1, 0, 0])
    x = np.zeros((len(raw), quality.FEATURES))
    x[:, 0] = raw
    rows = spark.createDataFrame(list(zip(range(len(raw)), x.tolist(), label.tolist())), "doc_id long, x array<double>, label int")
    model = quality.QualityModel(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.eye(quality.FEATURES)[0], 0.0, 1.0)
    ordered, at = np.sort(raw), round(best_quantile(raw, label) * len(raw))
    at = min(len(raw) - 1, max(1, at))
    assert quality.best_cut(rows, model) == (ordered[at - 1] + ordered[at]) / 2


@pytest.mark.parametrize("name, label, recall, precision", [("op9_quality", "quality", 0.97, 0.97), ("op7_toxicity", "toxic", 0.8, 0.9)])
def test_held_out_accuracy(spark, name, label, recall, precision):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = QUERIES[name](spark, BIG).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    cut = 0.7 if label == "quality" else 0.3
    assert all(r.predicted == (r.score >= cut) for r in rows)
    apart = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    right = sum(a and b for a, b in apart)
    assert right / sum(a for a, _ in apart) > recall
    assert right / sum(b for _, b in apart) > precision
    if label == "quality":
        assert sum(not a and not b for a, b in apart) / sum(not a for a, _ in apart) > 0.97


def test_factorization_machine_learns_a_pair():
    """Neither term alone says anything: the label is whether both or none stand."""
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2, (3000, 2))
    label = (both[:, 0] != both[:, 1]).astype(float)
    inputs = [np.flatnonzero(b) for b in both]
    bias, weights, factors = toxicity.fit(inputs, label, 2)
    model = [bias, bias + weights[0], bias + weights[1], bias + weights.sum() + factors[0] @ factors[1]]
    assert model[0] < -1 and model[1] > 1 and model[2] > 1 and model[3] < -1


def test_held_out_labels_are_not_learnt(spark):
    ids = range(600)
    texts = [prose(30, i) + (" grim" if i % 3 == 0 else "") for i in ids]
    df = frame(spark, texts)
    good = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in ids]
    turned = [(i, q ^ held_out(i), t ^ held_out(i)) for i, q, t in good]
    for operator in (quality.quality, toxicity.toxicity):
        a, b = (sorted((r.doc_id, round(r.score, 9)) for r in operator(df, labels(spark, rows)).collect()) for rows in (good, turned))
        assert a == b
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(df, labels(spark, good)).collect()}
    assert all(found[i] == (i % 3 == 0) for i in ids)


def test_edges(spark):
    df = clashing(frame(spark, ["fine words here"] * 5 + [None, "", "x" * 100_000, "# $ %%% " * 50], ids=[1, 1, 2, None, 3, 4, 5, 6, 7]))
    known = labels(spark, [(1, 1, 0), (1, 0, 1), (2, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, None)])
    for operator in (quality.quality, toxicity.toxicity):
        rows = operator(df, known).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        assert operator(frame(spark, []), known).collect() == []
    none = labels(spark, [])
    assert {r.score for r in quality.quality(df, none).collect()} == {0.7}
    assert {r.predicted for r in toxicity.toxicity(df, none).collect()} == {0}
    kept = quality_filter(df, none)
    assert kept.columns == df.columns and kept.count() == 9


def test_terms_over_several_parts(monkeypatch):
    from lodestone.llm import plainwords

    body = (prose(300, 1) + " Straße ÄRGER x").encode()
    whole = np.sort(toxicity.terms(body))
    monkeypatch.setattr(plainwords, "PART", 101)
    assert np.sort(toxicity.terms(body)).tolist() == whole.tolist()
    assert len(plainwords.hashes(b"One, two-three")) == 3
    assert plainwords.hashes(b"ONE!")[0] == plainwords.hashes(b"one")[0]


def test_toxic_by_two_words_of_which_neither_says_anything_alone(spark):
    """A group's name and a mild word, each as frequent in toxic texts as in others; toxic is who has both or neither."""
    rng = np.random.default_rng(4)
    has = rng.integers(0, 2, (1600, 2))
    toxic = (has[:, 0] == has[:, 1]).astype(int)
    texts = [" ".join([prose(25, i, 400), *(["folk"] if a else []), *(["pests"] if b else [])]) for i, (a, b) in enumerate(has.tolist())]
    found = toxicity.toxicity(frame(spark, texts), labels(spark, [(i, 1, t) for i, t in enumerate(toxic.tolist())]))
    apart = [(toxic[r.doc_id], r.predicted) for r in found.collect() if r.held_out]
    assert np.mean([a == b for a, b in apart]) > 0.97


def test_as_many_toxic_words_as_there_are(spark):
    """600 words, each in eight of 600 toxic texts and in no other."""
    ids = [i for i in range(9000) if not held_out(i)][:6000]
    texts = [" ".join([prose(12, i, 300), *(f"vile{(8 * n + j) % 600}" for j in range(8) if n < 600)]) for n, i in enumerate(ids)]
    model = toxicity.train(frame(spark, texts, ids=ids), labels(spark, [(i, 1, int(n < 600)) for n, i in enumerate(ids)]))
    assert np.isin([toxicity.terms(f"vile{w}".encode())[0] for w in range(600)], model.slots).all()


def test_every_toxic_label_is_learnt(spark):
    """Of 20,400 labelled texts only the 400 of the largest hashes of their ids are toxic."""
    from pyspark.sql import functions as F

    ids = [i for i in range(28_000) if not held_out(i)][:20_400]
    order = spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    toxic = {r.doc_id for r in order[20_000:]}
    texts = [f"some words here{' vile' if i in toxic else ''}" for i in ids]
    model = toxicity.train(frame(spark, texts, ids=ids), labels(spark, [(i, 1, int(i in toxic)) for i in ids]))
    assert model.score(b"some words here vile") > 0.9
    assert model.score(b"some words here") < 0.1


def test_parts_learn_together(spark, monkeypatch):
    """Toxic is who has both words or neither, learnt in four parts whose states are averaged."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    both = np.random.default_rng(6).integers(0, 2, (4000, 2))
    label = (both[:, 0] == both[:, 1]).astype(int)
    rows = [(i, np.flatnonzero(b).tolist(), y) for i, (b, y) in enumerate(zip(both, label.tolist(), strict=True))]
    bias, w, v = toxicity.fit_parts(spark.createDataFrame(rows, "doc_id long, x array<long>, label int"), 4000, int(label.sum()), 2)
    assert bias > 1 and bias + w[0] < -1 and bias + w[1] < -1 and bias + w.sum() + v[0] @ v[1] > 1


@pytest.mark.parametrize("block, copies", [(4096, 8), (7, 1)])
def test_pairs_against_all_pairs(spark, monkeypatch, block, copies):
    """Blocks that cannot be sure are left out, and rounds and block sizes change nothing."""
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", block)
    monkeypatch.setattr(toxicity, "PAIR_COPIES", copies)
    rng = np.random.default_rng(8)
    texts = [set(rng.zipf(1.3, 40)[:30].clip(max=60).tolist()) for _ in range(1500)]
    label = [int(({1, 2} <= t) != ({3, 9} <= t) if rng.random() < 0.9 else rng.random() < 0.3) for t in texts]
    bodies = [" ".join(f"w{x}" for x in sorted(t)).encode() for t in texts]
    found = toxicity.paired(spark.createDataFrame(list(zip(bodies, label, strict=True)), "body binary, label int").repartition(3), 1500, sum(label), 10, 8.0)
    held = {x: np.array([x in t for t in texts]) for x in range(1, 61)}
    held = {x: h for x, h in held.items() if h.sum() >= 10}
    y, base = np.array(label), np.log(sum(label) / (1500 - sum(label)))
    share = {x: (y[h].sum() + y.mean()) / (h.sum() + 1) for x, h in held.items()}
    odds = {x: np.log(s / (1 - s)) for x, s in share.items()}
    right = set()
    for a in held:
        for b in held:
            n = (held[a] & held[b]).sum()
            if a < b and n and toxicity.unexpected(n, y[held[a] & held[b]].sum(), odds[a], odds[b], base) >= 8.0:
                right |= {a, b}
    assert right and len(right) < len(held)
    assert found.tolist() == sorted(toxicity.words(f"w{x}".encode())[0] for x in right)


def test_words_go_only_to_blocks_where_a_pair_may_be_sure(spark, monkeypatch):
    """600 words of twelve documents each can be sure with no other, and are not dealt."""
    def counted(*args, deal=toxicity._dealer):
        def emit(batches):
            for batch in deal(*args)(batches):
                dealt.add(sum(len(v.as_py()) for c in ("a", "b") for v in batch.column(c)))
                yield batch

        return emit

    dealt = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(toxicity, "_dealer", counted)
    rng = np.random.default_rng(4)
    has = rng.integers(0, 2, (1200, 2)).astype(bool)
    rare = [rng.permutation(1200)[:12] for _ in range(600)]
    texts = [[w for w, there in zip(("one", "two"), h, strict=True) if there] for h in has]
    for w, docs in enumerate(rare):
        for d in docs:
            texts[d].append(f"rare{w}")
    label = (has[:, 0] == has[:, 1]).astype(int).tolist()
    rows = spark.createDataFrame([(" ".join(t).encode(), y) for t, y in zip(texts, label, strict=True)], "body binary, label int").repartition(2)
    found = toxicity.paired(rows, 1200, sum(label))
    assert found.tolist() == sorted(toxicity.words(w)[0] for w in (b"one", b"two"))
    assert 0 < dealt.value < 3000


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for values in (np.zeros(0, np.uint16), np.array([65535, 0, 7], np.uint16), rng.integers(0, 65536, 5000).astype(np.uint16)):
        assert toxicity._unpacked(toxicity._packed(values)).tolist() == values.tolist()


def test_rows_are_dealt_to_parts_once(spark, monkeypatch):
    """Four parts learn in eight rounds, and the rows are read for the first of them only."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for part in batches:
            read.add(len(part))
            yield part

    label = np.random.default_rng(7).integers(0, 2, 4000).tolist()
    schema = "doc_id long, x array<long>, label int"
    rows = spark.createDataFrame([(i, [0, y], y) for i, y in enumerate(label)], schema).mapInPandas(counted, schema)
    toxicity.fit_parts(rows, 4000, sum(label), 2)
    assert read.value == 4000


def test_texts_are_not_shuffled_to_their_labels(spark):
    """Joined by lists of ids that are sent, whatever Spark would broadcast by itself; beyond the limit as ever."""
    docs = spark.createDataFrame([(i % 300, f"t{i}".encode()) for i in range(400)] + [(None, b"none")], "doc_id long, body binary")
    given = labels(spark, [(i, 1, int(i % 7 == 0)) for i in range(0, 350, 2)] + [(i, 0, 0) for i in range(0, 300, 28)] + [(None, 1, 1), (3, 1, None), (5, 1, 2)])
    wanted = sorted(tuple(r) for r in quality.training_rows(docs, given, "toxic").select("doc_id", "body", "label").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity.labelled(docs, given)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(tuple(r) for r in found.select("doc_id", "body", "label").collect()) == wanted and {r[2] for r in wanted} == {0, 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LABELS_SENT", 3)
    docs = spark.createDataFrame([(i, b"") for i in range(40)], "doc_id long, body binary")
    found = toxicity.labelled(docs, labels(spark, [(i, 1, i % 2) for i in range(40)])).select("doc_id", "label").collect()
    assert sorted(map(tuple, found)) == [(i, i % 2) for i in range(40) if not held_out(i)]


@pytest.mark.parametrize("size", [40, 4])
def test_words_are_copied_by_bundles_and_not_by_sides(monkeypatch, size):
    """2000 words that may all be sure with each other go to as many bundles if sides are ten times as many."""
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", size)
    n = np.random.default_rng(9).zipf(1.5, 2000).clip(10, 5000)
    blocks = toxicity._Blocks.of(n, np.zeros(2000), np.zeros(2000, np.int64), np.ones((1, 1), bool))
    sides = len(blocks.starts) - 1
    assert sides >= 2000 // size and len(blocks.bundles) - 1 <= max(toxicity.PAIR_SIDES * 2 + toxicity.BUNDLES, sides // toxicity.BUNDLE_SIDES + toxicity.PAIR_SIDES * 2)
    assert blocks.bundles[0] == 0 and blocks.bundles[-1] == sides and (np.diff(blocks.bundles) > 0).all()
    assert blocks.copies.sum() <= (len(blocks.bundles) - 1) * n.sum()


def test_pairs_of_bundles_of_several_sides(spark, monkeypatch):
    """The same words whether each side is dealt alone or several together."""
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 3)
    rng = np.random.default_rng(12)
    texts = [set(rng.zipf(1.3, 40)[:30].clip(max=60).tolist()) for _ in range(1000)]
    label = [int(({1, 2} <= t) != ({30, 9} <= t)) for t in texts]
    rows = spark.createDataFrame([(" ".join(f"w{x}" for x in sorted(t)).encode(), y) for t, y in zip(texts, label, strict=True)], "body binary, label int").repartition(2)
    found = []
    for sides in (1, 16):
        monkeypatch.setattr(toxicity, "BUNDLE_SIDES", sides)
        found.append(toxicity.paired(rows, 1000, sum(label), 10, 8.0).tolist())
    assert found[0] == found[1] and found[0]


def test_joined_bytes_come_back():
    for parts in ([], [b""], [b"a", b"", b"bcd"]):
        assert toxicity._parted(toxicity._joined(parts)) == parts


def test_terms_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(13)
    bodies = [b"", b" ", *(" ".join(f"Word{x}" for x in rng.integers(0, 400, rng.integers(1, 40))).encode() for _ in range(200)), b"word7 " * 200_000, b"", b"Word9"]
    slots = np.unique(np.concatenate([toxicity.terms(b) for b in bodies]))[::3]
    for beginnings, of in ((True, toxicity.terms), (False, toxicity.words)):
        found = toxicity.matches(bodies, slots, beginnings)
        assert [slots[x].tolist() for x in found] == [np.intersect1d(of(b), slots).tolist() for b in bodies]
    assert toxicity.matches([], slots, True) == [] and [len(x) for x in toxicity.matches([b"a", b"b"], slots[:0], True)] == [0, 0]
