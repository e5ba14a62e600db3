"""Benchmark decontamination: rare words of items as seeds, then local alignment.

Texts are sequences of plain words (`plainwords`; a character of a script without spaces is a word). A leak is a passage whose
Smith-Waterman alignment with an item, over words, reaches `THRESHOLD` of the item's score against itself, and that holds `GRAM` of its words
at least; of an item of fewer words, all in a row. Edited and paraphrased copies score
less by what was changed. No leak is missed: such an alignment matches a certain number of the item's words on a stretch of a certain
length at most, so it holds a known number of any words that make up more than what may be missing. Those that occur least in the
documents are the item's seeds; stretches with as many of them as a leak must hold are aligned, however the edits lie.

Items are taken in blocks of about `BLOCK_WORDS` words, the bound of what a task is handed; documents are read twice a block (to count
the words, to align), whole, and nothing of them is shuffled but counts. A benchmark of any size takes as many blocks as it needs. The texts of a
slice of an Arrow batch are hashed, searched for seeds and aligned together, each step over all of them.

Null and empty texts and items match nothing; a very long text is a slice of its own. Of equal items, each is reported; of rows
of equal id, each for itself. A document that holds an item several times gives a row for each. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.llm.common import text_bytes
from lodestone.llm.plainwords import hashes, hashes_of_all

GRAM = 3
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, SPACE = 2, -1, -1
#: Of the matches that a leak must have, the share that its seeds are sure to hold.
SHARE = 0.5
#: Pairs of a seed in a text and an item that are held at a time, besides those of one leak's length.
HITS = 1_000_000
#: Words of texts that are aligned together, with what pads them.
CELLS = 1 << 17
#: Bytes of texts that are searched together.
SLICE = 1 << 21
_FILTER_BITS = 22


class Lookup:
    """Which of many hashes are in a sorted set, and where; a bitmap turns most away."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.values >> np.uint64(64 - _FILTER_BITS)] = True

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `wanted`, and the numbers of their values."""
        places = np.flatnonzero(self.bits[wanted >> np.uint64(64 - _FILTER_BITS)])
        if not len(places) or not len(self.values):
            return places[:0], places[:0]
        number = np.minimum(np.searchsorted(self.values, wanted[places]), len(self.values) - 1)
        same = self.values[number] == wanted[places]
        return places[same], number[same]


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix, and which of its places are theirs."""
    sizes = np.array([len(r) for r in rows])
    inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
    table = np.zeros(inside.shape, np.uint64)
    table[inside] = np.concatenate([np.zeros(0, np.uint64), *rows])
    return table, inside


def _fill(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the best score of a local alignment, and the text's words up to its end: all pairs, an item's word a step."""
    item, in_item = _padded(items)
    text, in_text = _padded(texts)
    n, width = text.shape
    slope = np.arange(1, width + 1, dtype=np.int32) * np.int32(SPACE)
    row, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    every = np.arange(n)
    for step in range(item.shape[1] if width else 0):
        same = (text == item[:, step, None]) & in_text & in_item[:, step, None]
        now = np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + np.int32(SPACE))
        np.maximum(now, 0, out=now)
        # A space in the item costs the same at each step along the row. What pads a row never scores more than what is left of it.
        now -= slope
        np.maximum.accumulate(now, axis=1, out=now)
        now += slope
        row[:, 1:] = now
        at = now.argmax(axis=1)
        high = now[every, at]
        more = high > best
        best[more], end[more] = high[more], at[more] + 1
    return best.astype(np.int64), end


def align_all(items: list[np.ndarray], texts: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, and the aligned stretches of the texts (start, end), of pairs; a score below `least` has none (its start is its end)."""
    score, start, end = (np.zeros(len(items), np.int64) for _ in range(3))
    order = sorted(range(len(items)), key=lambda i: (len(texts[i]), len(items[i])))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(texts[order[stop]]) <= CELLS and len(texts[order[stop]]) <= 1.3 * len(texts[order[at]]) + 16:
            stop += 1
        some = np.array(order[at:stop])
        score[some], end[some] = _fill([items[i] for i in some], [texts[i] for i in some])
        good = some[score[some] >= least[some]]
        start[some] = end[some]
        if len(good):
            start[good] -= _fill([items[i][::-1] for i in good], [texts[i][: end[i]][::-1] for i in good])[1]
        at = stop
    return score, start, end


def align(item: np.ndarray, text: np.ndarray, least: int = 0) -> tuple[float, int, int]:
    """Score as a share of the item's own, and the aligned stretch of the text (start, end; none if the score is below `least`)."""
    score, start, end = align_all([item], [text], np.array([least]))
    return int(score[0]) / (MATCH * len(item)), int(start[0]), int(end[0])


def least_score(size: int, threshold: float) -> int:
    """The least score of a leak of an item of `size` words; one of fewer than `GRAM` matches is none, but for shorter items, as they are."""
    return MATCH * size if size < GRAM else max(math.ceil(MATCH * size * threshold - 1e-9), MATCH * (GRAM - 1) + 1)


@dataclass
class Items:
    """A block of items, with their seeds."""

    ids: list[int]
    words: list[np.ndarray]
    scores: np.ndarray  # the least score of a leak of each item
    least: np.ndarray  # the least sum of `MATCH` for each of its seeds and `SPACE` for each other word between them
    span: np.ndarray  # over how many words of a text, at most
    seeds: Lookup
    first: np.ndarray  # the items of seed n are held[first[n] : first[n + 1]]
    held: np.ndarray
    different: dict[int, np.ndarray] = field(default_factory=dict)

    def leaks(self, body: bytes) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, last word, score) of each leak in a text."""
        for _, *leak in self.leaks_of_all([body]):
            yield tuple(leak)

    def leaks_of_all(self, bodies: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, last word, score) of each leak in some texts."""
        words, begins = hashes_of_all(bodies, unspaced=True)
        return self.aligned(list(self._stretches(words, begins)), words, begins)

    def _stretches(self, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of all stretches that may hold a leak; those of an item do not overlap."""
        at, seed = self.seeds(words)
        if not len(at):
            return
        # Texts are moved so far apart that neither seeds nor what lies around them reach from one to the next.
        sizes, reach = np.diff(begins), 2 * int(self.span.max()) + 2
        moved = np.concatenate(([0], np.cumsum((MATCH + 2) * sizes + reach)))
        text = np.searchsorted(begins, at, side="right") - 1
        at = at - begins[text] + moved[text]
        pairs = np.concatenate(([0], np.cumsum(self.first[seed + 1] - self.first[seed])))
        found, begin = [], 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(pairs, pairs[begin] + HITS, "right")) - 1)
            more = int(np.searchsorted(at, at[end - 1] + self.span.max()))
            found.append(self._windows(at[begin:more], seed[begin:more]))
            begin = end
        item, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(item):
            return
        order = np.lexsort((start, item))
        item, start, end = item[order], start[order], end[order]
        edge = np.flatnonzero((item[1:] != item[:-1]) | (start[1:] > end[:-1])) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(item)])) - 1
        # The middle of what is around a seed is a place of its text.
        owner = np.searchsorted(moved, start[first] + self.span[item[first]], side="right") - 1
        low, high = np.maximum(start[first] - moved[owner], 0), np.minimum(end[last] - moved[owner], sizes[owner])
        yield from zip(owner.tolist(), item[first].tolist(), low.tolist(), high.tolist(), strict=True)

    def _windows(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start and end of what may be a leak that holds the seeds given, around each seed that may be a leak's last."""
        many = self.first[seed + 1] - self.first[seed]
        number = np.arange(many.sum()) + np.repeat(self.first[seed] - (np.cumsum(many) - many), many)
        item, place = self.held[number], np.repeat(at, many)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order].astype(np.int64)
        # Sums of the seeds' worth less the words they stand among; a later item's sums are below those of all earlier ones.
        before = (MATCH + 1) * np.arange(len(item)) - place - item * np.int64((MATCH + 1) * len(item) + int(at[-1]) + 1)
        best = before + MATCH - np.minimum.accumulate(before)
        last = np.flatnonzero(best >= self.least[item])
        item, place = item[last], place[last]
        return item, place - self.span[item] + 1, place + self.span[item]

    def _narrowed(self, item: int, text: np.ndarray) -> tuple[int, int] | None:
        """The part of a stretch that may hold a leak: no alignment scores more than if all the item's words matched wherever they stand."""
        own, least = self.own(item), int(self.scores[item])
        near = np.minimum(np.searchsorted(own, text), len(own) - 1)
        sums = np.concatenate(([0], np.cumsum(np.where(own[near] == text, MATCH, SPACE))))
        ends = np.flatnonzero(sums - np.minimum.accumulate(sums) >= least)
        if not len(ends):
            return None
        starts = np.flatnonzero(np.maximum.accumulate(sums[::-1])[::-1] - sums >= least)
        return int(starts[0]), int(ends[-1])

    def own(self, item: int) -> np.ndarray:
        """The different words of an item."""
        if item not in self.different:
            self.different[item] = np.unique(self.words[item])
        return self.different[item]

    def aligned(self, stretches: list[tuple[int, int, int, int]], words: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """The best alignment of each stretch, then those of what lies before and behind it."""
        found = []
        while stretches:
            kept = []
            for text, item, a, b in stretches:
                part = self._narrowed(item, words[begins[text] + a : begins[text] + b]) if a < b else None
                if part is not None:
                    kept.append((text, item, a, b, a + part[0], a + part[1]))
            least = self.scores[[k[1] for k in kept]] if kept else np.zeros(0, np.int64)
            bodies = [words[begins[text] + near : begins[text] + far] for text, _, _, _, near, far in kept]
            score, start, end = align_all([self.words[k[1]] for k in kept], bodies, least)
            stretches = []
            for i in np.flatnonzero(score >= least).tolist():
                text, item, a, b, near, _ = kept[i]
                low, high = near + int(start[i]), near + int(end[i])
                found.append((text, item, low, high - 1, int(score[i]) / (MATCH * len(self.words[item]))))
                stretches += [(text, item, a, low), (text, item, high, b)]
        return found


def _slices(bodies: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about `SLICE` bytes at a time, with the place of the first."""
    at = 0
    while at < len(bodies):
        end, size = at + 1, len(bodies[at])
        while end < len(bodies) and size + len(bodies[end]) <= SLICE:
            size += len(bodies[end])
            end += 1
        yield at, bodies[at:end]
        at = end


def _blocks(benchmark: DataFrame) -> Iterator[pd.DataFrame]:
    """The items (`item_id`, `body`) in blocks."""
    items = benchmark.select(F.col("item_id").cast("long"), text_bytes().alias("body"))
    words = items.agg(F.sum(F.regexp_count(F.col("body").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    count = math.ceil(words / BLOCK_WORDS)
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(count)) == block)
        yield part.toPandas().sort_values(["item_id", "body"], kind="stable", na_position="first")


def _occurrences(docs: DataFrame, wanted: Lookup) -> np.ndarray:
    """How often each of the wanted words stands in the documents; a task sends one row for each at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.values), np.int64)
        for batch in batches:
            for _, bodies in _slices(batch.column(0).to_pylist()):
                total += np.bincount(wanted(hashes_of_all(bodies, unspaced=True)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["number", "n"])

    counted = docs.select(text_bytes()).mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(wanted.values), np.int64)
    out[counted["number"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def _seeds(ids: list, words: list[np.ndarray], every: Lookup, often: np.ndarray, threshold: float) -> Items:
    """Items with the words that make up what a leak may miss and `SHARE` of what it must match, the rarest first."""
    scores = np.array([least_score(len(w), threshold) for w in words], np.int64)
    least, chosen = np.zeros(len(words), np.int64), []
    for item, own in enumerate(words):
        # A score of n takes n / `MATCH` matches; the other words of the item may be missing.
        matches = -(-int(scores[item]) // MATCH)
        missing = len(own) - matches
        if missing < 0 or not len(own):
            continue
        numbers, copies = np.unique(np.searchsorted(every.values, own), return_counts=True)
        order = np.argsort(often[numbers], kind="stable")
        places = np.cumsum(copies[order])
        size = int(np.searchsorted(places, missing + max(1, math.ceil(matches * SHARE)))) + 1
        # Each match of another word raises the score by `MATCH`, and is one of those that stand between the seeds.
        least[item] = scores[item] - (MATCH - SPACE) * (len(own) - places[size - 1])
        chosen.append(np.stack((numbers[order[:size]], np.full(size, item))))
    seed, held = np.concatenate([np.zeros((2, 0), np.int64), *chosen], axis=1)
    first = np.concatenate(([0], np.cumsum(np.unique(seed, return_counts=True)[1])))
    # Each match takes one word of the text and pays for `MATCH` others that do not.
    span = np.array([(MATCH + 1) * len(w) for w in words], np.int64) - scores
    return Items(ids, words, scores, least, span, Lookup(every.values[seed]), first, held[np.argsort(seed, kind="stable")])


def seeded(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    """Blocks of items with their seeds."""
    for block in _blocks(benchmark):
        words = [hashes(b, unspaced=True) for b in block["body"]]
        every = Lookup(np.concatenate([np.zeros(0, np.uint64), *words]))
        ids = [None if pd.isna(i) else int(i) for i in block["item_id"]]
        yield _seeds(ids, words, every, _occurrences(docs, every), threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `item_id`, `first_word`, `last_word` (plain words from 0), `score` (to 1), a row for each leaked passage."""
    names = ["doc_id", "item_id", "first_word", "last_word", "score"]
    schema = "doc_id long, item_id long, first_word long, last_word long, score double"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    out = docs.sparkSession.createDataFrame([], schema)
    for items in seeded(docs, benchmark, threshold):

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [
                    (ids[at + text], items.ids[item], first, last, score)
                    for at, bodies in _slices(batch.column(1).to_pylist())
                    for text, item, first, last, score in items.leaks_of_all(bodies)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("body")).mapInArrow(search, schema))
    return out


def _leaked(items: Items, text: Column) -> Column:
    @pandas_udf("boolean")
    def leaked(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in bodies:
            held = np.zeros(len(part), bool)
            for at, some in _slices(part.tolist()):
                held[[at + leak[0] for leak in items.leaks_of_all(some)]] = True
            yield pd.Series(held)

    return leaked(text_bytes(text))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns, that hold no leak."""
    for items in seeded(docs, benchmark, threshold):
        docs = docs.where(~_leaked(items, docs["text"]))
    return docs
