"""Suffix-array dedup: byte strings of a given length that occur more than once are cut out of documents.

Runs of windows that share an anchor (`shared_windows`) meet in one task, which sorts the suffixes at their window starts. Only
matches of `length` bytes count, so the suffix order is needed to that depth: it comes from prefix doubling, and the
suffixes that share `length` bytes are an interval of it. Within its interval a suffix has an earlier match, that is, a
longest previous factor of at least `length`, if and only if a previous or a next smaller position lies there; the mirrored test
with larger positions gives later matches. `keep="first"` removes what has an earlier match, `keep="none"` what has any.

Null texts are empty; documents shorter than `length` keep all. Rows with equal id and text are separate documents
for `keep="none"` and one for `keep="first"`. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import keyed, public_id
from lodestone.llm.shared_windows import removed_windows, stretches_by_document
from lodestone.llm.windows import covered, stretches, table

#: Bytes of a gram; a window's anchor is one of its grams.
GRAM = 64
#: Bytes of runs that one suffix array holds, beyond which the next is begun (at a whole block).
ARRAY_BYTES = 1 << 19
_ONE, _TWO = table(1), table(2)


def _units(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(body, np.uint8)
    return _Lookup(values, _ONE), _Lookup(values, _TWO)


def _content_values(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(content, np.uint8)
    return _ONE[values], _TWO[values]


class _Lookup:
    """Hashed values of bytes, made when a stretch is asked for."""

    def __init__(self, values: np.ndarray, values_of: np.ndarray):
        self.values, self.values_of = values, values_of

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, stretch: slice) -> np.ndarray:
        return self.values_of[self.values[stretch]]


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys, in the order of the keys."""
    order = np.argsort(key)
    ordered = key[order]
    step = np.ones(len(key), np.uint64)
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(step)
    return rank


def suffix_ranks(text: np.ndarray, length: int, wanted: np.ndarray) -> np.ndarray:
    """Ranks of the wanted suffixes by their first `length` bytes: equal ranks for equal strings."""
    depth = min(8, 1 << (length.bit_length() - 1))
    key = np.zeros(len(text), np.uint64)
    for i in range(depth):
        key[: len(text) - i] |= text[i:].astype(np.uint64) << np.uint64(8 * (7 - i))
    if depth == length:
        return _dense(key[wanted])
    rank = _dense(key)

    def joined(at: np.ndarray, ahead: int) -> np.ndarray:
        key = rank[at] << np.uint64(32)
        there = at + ahead < len(rank)
        key[there] |= rank[at[there] + ahead]
        return key

    everywhere = np.arange(len(text))
    while depth * 2 <= length:
        key = joined(wanted if depth * 2 == length else everywhere, depth)
        if depth * 2 == length:
            return _dense(key)
        rank, depth = _dense(key), depth * 2
    return _dense(joined(wanted, length - depth))


def previous_factors(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in text order with their ranks: has an earlier match, has a later match, and the matches of each first one.

    Suffixes of equal rank are an interval of the suffix order. The least position before a suffix and the least behind it,
    within the interval, tell whether a smaller one stands on either side; the greatest tell the same of larger ones.
    """
    size = len(rank)
    order = np.argsort(rank)  # the suffix array, to the depth of the ranks
    interval = rank[order].astype(np.int64)
    stride = size + 1

    def smaller_before(position: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether a smaller position stands before, in the same interval; intervals are numbered upwards."""
        lows = np.minimum.accumulate(position - which * stride)
        out = np.zeros(size, bool)
        out[1:] = (which[1:] == which[:-1]) & (lows[:-1] + which[1:] * stride < position[1:])
        return out

    def either_side(position: np.ndarray) -> np.ndarray:
        return smaller_before(position, interval) | smaller_before(position[::-1], interval[-1] - interval[::-1])[::-1]

    earlier, later = np.zeros(size, bool), np.zeros(size, bool)
    if size:
        earlier[order] = either_side(order)
        later[order] = either_side(size - order)
    counts = np.where(earlier, 0, np.bincount(rank.astype(np.int64), minlength=1)[rank.astype(np.int64)])
    return earlier, later, counts


def _matcher(length: int, keep_first: bool):
    def solve(blocks: list) -> Iterator[tuple]:
        contents = [row[5] for _, group in blocks for row in group]
        sizes = np.array([len(c) for c in contents], np.int64)
        starts = np.cumsum(sizes) - sizes
        counts = np.array([row[3] for _, group in blocks for row in group], np.int64)
        ends = np.cumsum(counts)
        wanted = np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
        text = np.frombuffer(b"".join(contents), np.uint8)
        earlier, later, same = previous_factors(suffix_ranks(text, length, wanted))
        repeated = earlier if keep_first else earlier | later
        at = 0
        for key, group in blocks:
            cuts = [(at := at + row[3]) - row[3] for row in group]
            yield key, group, [repeated[c : c + r[3]] for c, r in zip(cuts, group, strict=True)], [
                same[c : c + r[3]] for c, r in zip(cuts, group, strict=True)
            ]

    def match(blocks: Iterator[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for block in blocks:
            held.append(block)
            size += sum(len(row[5]) for row in block[1])
            if size >= ARRAY_BYTES:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    return match


def repeated_strings(docs: DataFrame, length: int = 400, keep: str = "none", gram: int = GRAM) -> DataFrame:
    """`did`, `rk`, `s`, `n`: stretches of `n` starts from byte `s` of strings of `length` bytes that are to go."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    gram = min(gram, length)

    return removed_windows(
        keyed(docs), _units, lambda body: lambda pos, n: body[pos : pos + n + length - 1],
        _matcher(length, keep == "first"), _content_values, gram, length, keep == "first",
    )


_OUT = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<s: long, e: long>>"


def _apply(length: int, texts: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    names = ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for did, body, cuts in zip(*(batch.column(i) for i in range(3)), strict=True):
                body, spans, removed, kept = body.as_py(), [], 0, None
                if cuts.is_valid:
                    s, n = (cuts.values.field(k).to_numpy(zero_copy_only=False) for k in ("s", "n"))
                    flags = covered(len(body), s, s + n + length - 1)
                    spans = [{"s": a, "e": b} for a, b in zip(*(x.tolist() for x in stretches(flags)), strict=True)]
                    removed, kept = int(flags.sum()), np.frombuffer(body, np.uint8)[~flags].tobytes()
                rest = body if kept is None else kept
                row = (did.as_py(), len(body), removed, len(spans), hashlib.sha256(rest).hexdigest(), rest if texts else None, spans if texts else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return apply


def suffix_dedup(docs: DataFrame, length: int = 400, keep: str = "none", texts: bool = True) -> DataFrame:
    """One row per document: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, and with `texts` also `kept` and `spans`.

    `kept` is what remains, as bytes (a cut may fall inside a character); `spans` are the maximal removed stretches.
    """
    cuts = stretches_by_document(repeated_strings(docs, length, keep))
    out = (
        keyed(docs).join(cuts, ["did", "rk"], "left").select("did", "body", "cuts")
        .mapInArrow(_apply(length, texts), _OUT)
    )
    digest = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(public_id(), *digest, *(["kept", "spans"] if texts else []))
