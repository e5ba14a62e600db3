"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a quantile of scores.

Each pair of a document of label 1 and one of label 0 is a preference; the chance that it holds is the logistic function of the
difference of two linear scores, and the weights minimise the mean logistic loss over all pairs of all labelled documents. The
cut is the quantile of the training scores that parts the labels best; scores are then mapped to 0..1 so that the cut lies at `CUT`.

Pairs are not made. The chance of a pair depends on its two scores alone, so each Newton step sums the features of a label's rows
over the nodes of an interpolation along the score (`NODES` to a stretch of `WIDTH`, exact to about 1e-9) in Spark tasks, and
weighs pairs of nodes. Rows are sorted into ranges of scores for the cut. The driver holds sums over nodes and over ranges.

Every document is scored, whole. Null and empty texts have the features of an empty text and a score as any other. Rows without an
id are scored too and never learnt from; repeated rows have equal scores; of several labels of one id the smallest counts. Without
labels of both kinds there is no preference, and every document has the score `CUT`. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.llm.common import Stored, learnable, text_bytes

#: The score at the cut.
CUT = 0.7
#: Chebyshev nodes to a stretch of scores, and its width.
NODES = 12
WIDTH = 2.0
#: Rows whose products of features are held at once.
SLICE = 2048

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" ", "line": b"\n\r", "stop": b".,;:?", "bang": b"!", "bar": b"|\\/<>{}[]_=", "sign": b"#$%&*@^~+",
    "high": bytes(range(128, 256)),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
FEATURES = 2 * (len(_CLASSES) + 1) + 8


def features(body: bytes) -> np.ndarray:
    """Lengths, shares of kinds of bytes, and repetition of words."""
    out = np.zeros(FEATURES)
    if not body:
        return out
    shares = np.bincount(_CLASS[np.frombuffer(body, np.uint8)], minlength=len(_CLASSES) + 1) / len(body)
    words = body.split()
    n = max(1, len(words))
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    distinct = len(set(words))
    size = len(shares)
    out[:size], out[size : 2 * size] = shares, np.sqrt(shares)
    out[2 * size :] = (
        math.log1p(len(body)), math.log1p(len(words)), len(body) / n / 10, repeats, math.sqrt(repeats),
        distinct / n, math.log1p(n / max(1, distinct)), 1.0,
    )
    return out


def newton(terms: Callable, spread: Callable, size: int, penalty: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Weights at which the gradient is zero; `terms(w)` gives gradient and Hessian, `spread(step)` a step's largest change of a pair."""
    w = np.zeros(size)
    for _ in range(rounds):
        gradient, hessian = terms(w)
        step = np.linalg.solve(hessian + penalty * np.eye(size), gradient + penalty * w)
        change = spread(step)
        w -= step * min(1.0, 10 / max(change, 1e-12))
        if change < 1e-6:
            break
    return w


def _upset(margin: np.ndarray) -> np.ndarray:
    """The chance that a preference of this margin does not hold."""
    return 1 / (1 + np.exp(np.clip(margin, -30, 30)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Weights that minimise the mean logistic loss of the differences of given pairs."""
    d = better - worse

    def terms(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _upset(d @ w)
        return -(d * p[:, None]).mean(axis=0), (d * (p * (1 - p))[:, None]).T @ d / len(d)

    return newton(terms, lambda step: np.abs(d @ step).max(), d.shape[1], penalty, rounds)


_NODES = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_TO_NODES = np.linalg.inv(np.polynomial.chebyshev.chebvander(_NODES, NODES - 1))


def node_sums(z: np.ndarray, label: np.ndarray, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """By label and stretch of scores, for each node the sums of 1, `z` and the products of `z`, shared out over the nodes."""
    raw = z @ w
    stretch = np.floor(raw / WIDTH).astype(np.int64)
    out = {}
    for key in sorted(set(zip(label.tolist(), stretch.tolist(), strict=True))):
        at = np.flatnonzero((label == key[0]) & (stretch == key[1]))
        share = np.polynomial.chebyshev.chebvander(2 * (raw[at] / WIDTH - key[1]) - 1, NODES - 1) @ _TO_NODES
        part = z[at]
        products = (part[:, :, None] * part[:, None, :]).reshape(len(at), -1)
        out[key] = share.T @ np.concatenate((np.ones((len(at), 1)), part, products), axis=1)
    return out


def pair_terms(sums: dict[tuple[int, int], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean logistic loss of all pairs, from `node_sums` of all rows."""
    place = {stretch: (stretch + (_NODES + 1) / 2) * WIDTH for _, stretch in sums}
    sides = [sorted(stretch for label, stretch in sums if label == k) for k in (0, 1)]
    bad = np.concatenate([sums[0, s] for s in sides[0]])
    at_bad = np.concatenate([place[s] for s in sides[0]])
    gradient, hessian, weight_bad, pairs = np.zeros(size), np.zeros((size, size)), np.zeros(len(bad)), 0.0
    for s in sides[1]:
        good = sums[1, s]
        p = _upset(place[s][:, None] - at_bad)
        curve = p * (1 - p)
        gradient += good[:, 0] @ p @ bad[:, 1 : size + 1] - (p @ bad[:, 0]) @ good[:, 1 : size + 1]
        hessian += ((curve @ bad[:, 0]) @ good[:, size + 1 :]).reshape(size, size)
        weight_bad += good[:, 0] @ curve
        crossed = good[:, 1 : size + 1].T @ curve @ bad[:, 1 : size + 1]
        hessian -= crossed + crossed.T
        pairs += good[:, 0].sum() * bad[:, 0].sum()
    hessian += (weight_bad @ bad[:, size + 1 :]).reshape(size, size)
    return gradient / pairs, hessian / pairs


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def best_quantile(raw: np.ndarray, label: np.ndarray) -> float:
    """The quantile of the scores that, as a cut, maximises the mean share of rightly placed labels of either kind."""
    order = np.argsort(raw, kind="stable")
    wrong = np.cumsum(label[order] == 1) / max(1, (label == 1).sum())  # below a cut behind each
    right = np.cumsum(label[order] == 0) / max(1, (label == 0).sum())
    gain = right - wrong
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return (best[len(best) // 2] + 1) / len(raw)


def smallest_labels(labels: DataFrame, label: str) -> DataFrame:
    """`doc_id`, `label`: the learnable ids that have one, and the smallest of each."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learnable())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    )


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The learnable labelled rows of `docs`, with `label`; each row once, and the smallest label of its id."""
    return docs.where(learnable()).join(smallest_labels(labels, label), "doc_id")


def described(docs: DataFrame) -> DataFrame:
    """`doc_id`, and `x`, the features of the whole text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(b.as_py()) for b in batch.column("body")]).reshape(-1, FEATURES)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("body")).mapInArrow(extract, "doc_id long, x array<double>")


def folded(rows: DataFrame, part: Callable, fold: Callable = np.sum) -> dict[tuple[int, int], np.ndarray]:
    """`part(x, label)` gives an array for each of its keys; the arrays of a key are folded in the tasks, then over the tasks in their order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            label = batch.column("label").to_numpy()
            for at in range(0, len(label), SLICE):
                for key, value in part(x[at : at + SLICE], label[at : at + SLICE]).items():
                    held[key] = fold([held[key], value], axis=0) if key in held else value
        task = TaskContext.get().partitionId()
        if held:
            columns = [[a for a, _ in held], [b for _, b in held], [task] * len(held), [v.ravel() for v in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "task", "value"])

    def merge(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        value = fold(np.stack(held.sort_values("task")["value"].to_list()), axis=0)
        return pd.DataFrame({"a": key[:1], "b": key[1:], "value": [value]})

    parts = rows.select("x", "label").mapInArrow(emit, "a long, b long, task long, value array<double>")
    found = parts.groupBy("a", "b").applyInPandas(merge, "a long, b long, value array<double>").toPandas()
    return {(int(a), int(b)): np.asarray(v, float) for a, b, v in zip(found["a"], found["b"], found["value"], strict=True)}


def best_cut(rows: DataFrame, model: QualityModel) -> float:
    """The score halfway between the ranks that `best_quantile` parts, over all rows; ranks are sorted by ranges."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), batch.column("doc_id"), batch.column("label")], names=["raw", "doc_id", "label"])

    rated = rows.select("x", "doc_id", "label").mapInArrow(rate, "raw double, doc_id long, label int")
    stored = Stored(rated.repartitionByRange("raw", "doc_id", "label").withColumn("part", F.spark_partition_id()), "quality-ranges")
    counts = (F.count("*").alias("n"), F.sum("label").alias("ones"), F.min("raw").alias("least"), F.max("raw").alias("most"))
    totals = stored.df.groupBy("part").agg(*counts).toPandas().sort_values("part").reset_index(drop=True)
    n, ones = int(totals["n"].sum()), int(totals["ones"].sum())
    before = (totals[["n", "ones"]].cumsum() - totals[["n", "ones"]]).to_numpy().tolist()
    below = dict(zip(totals["part"].tolist(), before, strict=True))

    def gains(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """A range in order, and by how much a cut behind each row parts the labels, times the rows of either label."""
        part = part.sort_values(["raw", "doc_id", "label"], kind="stable")
        rank, wrong = below[int(part["part"].iloc[0])]
        label = part["label"].to_numpy(np.int64)
        return part, (rank - wrong + np.cumsum(1 - label)) * ones - (wrong + np.cumsum(label)) * (n - ones)

    def top(part: pd.DataFrame) -> pd.DataFrame:
        gain = gains(part)[1]
        return pd.DataFrame({"part": part["part"].iloc[:1], "gain": gain.max(), "hits": (gain == gain.max()).sum()})

    tops = stored.df.groupBy("part").applyInPandas(top, "part int, gain long, hits long").toPandas().sort_values("part")
    tops = tops[tops["gain"] == tops["gain"].max()]
    middle = int(tops["hits"].sum()) // 2
    ends = tops["hits"].cumsum()
    chosen = tops[ends > middle].iloc[0]
    skip = middle - int(ends[chosen.name] - chosen["hits"])

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part, gain = gains(part)
        at = np.flatnonzero(gain == gain.max())[skip]
        raw = part["raw"].to_numpy()
        beside = [raw[i] if 0 <= i < len(raw) else None for i in (at - 1, at, at + 1)]
        return pd.DataFrame([[below[int(part["part"].iloc[0])][0] + at, *beside]], columns=["rank", "last", "raw", "next"])

    found = stored.df.where(F.col("part") == int(chosen["part"])).groupBy("part").applyInPandas(pick, "rank long, last double, raw double, next double").first()
    stored.drop()
    at = int(totals.index[totals["part"] == chosen["part"]][0])
    if found["rank"] == n - 1:
        other = found["last"] if found["last"] is not None else totals["most"][at - 1]
    else:
        other = found["next"] if found["next"] is not None else totals["least"][at + 1]
    return float((found["raw"] + other) / 2)


def fit(rows: DataFrame) -> QualityModel:
    """A model from every pair of a good and a bad row of `rows(doc_id, x, label)`."""
    none = QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.0)
    sums = folded(rows, lambda x, label: {(int(k), 0): np.append(x[label == k].sum(axis=0), (label == k).sum()) for k in np.unique(label)})
    if len(sums) < 2:
        return none
    total = sum(sums.values())
    n, mean = total[-1], total[:-1] / total[-1]
    scale = np.sqrt(folded(rows, lambda x, label: {(0, 0): ((x - mean) ** 2).sum(axis=0)})[0, 0] / n) + 1e-6

    def terms(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = folded(rows, lambda x, label: node_sums((x - mean) / scale, label, w))
        return pair_terms({key: value.reshape(NODES, -1) for key, value in found.items()}, FEATURES)

    def spread(step: np.ndarray) -> float:
        def ends(x: np.ndarray, label: np.ndarray) -> dict:
            raw = (x - mean) / scale @ step
            return {(int(k), 0): np.array([raw[label == k].max(), -raw[label == k].min()]) for k in np.unique(label)}

        found = folded(rows, ends, np.max)
        return float(max(found[0, 0][0] + found[1, 0][1], found[1, 0][0] + found[0, 0][1]))

    model = QualityModel(mean, scale, newton(terms, spread, FEATURES), 0.0, 1.0)
    model.cut = best_cut(rows, model)
    return model


def train(described_docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from all learnable rows of `labels(doc_id, quality)` and the features of their documents."""
    stored = Stored(training_rows(described_docs, labels, "quality").select("doc_id", "x", "label"), "quality-rows")
    model = fit(stored.df)
    stored.drop()
    return model


def quality_score(model: QualityModel, column: Column | str = "text") -> Column:
    @pandas_udf("double")
    def score(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in bodies:
            yield pd.Series(model.score(np.array([features(b) for b in part]).reshape(-1, FEATURES)))

    return score(text_bytes(column))


def _score_of(model: QualityModel, column: str) -> Column:
    @pandas_udf("double")
    def score(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in rows:
            yield pd.Series(model.score(np.array(part.to_list(), float).reshape(-1, FEATURES)))

    return score(F.col(column))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` (1 from `CUT` on). Features are made once and stored."""
    found = Stored(described(docs), "quality-features").df
    model = train(found, labels)
    scored = found.select("doc_id", (~F.coalesce(learnable(), F.lit(True))).alias("held_out"), _score_of(model, "x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that score at least `CUT`."""
    return docs.where(quality_score(train(described(docs.where(learnable())), labels), docs["text"]) >= CUT)
