"""Substring dedup: word windows that already occurred are cut out, found with suffix automata.

A reference shard is what came earlier, in the order of id and place. Its suffix automaton is streamed over by the next document: the
matching statistics, that is, the length of the longest match that ends at each word, show the windows that the shard holds.
What is new in a document then enters the automaton, so a shard grows by novel text only. A shard serves the runs
of one anchor (`shared_windows`), and only the documents that hold this anchor can match it; they are routed to it by a
shuffle, since the shards together grow with the corpus and no size bound for a broadcast could be proven.

Null texts have no words; documents of fewer words than `length` keep all. Rows with equal id and text are one document, all of
them with the same result. A null id orders before all others. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from lodestone.llm.common import keyed, public_id
from lodestone.llm.shared_windows import removed_windows, second_values, stretches_by_document
from lodestone.llm.windows import covered, stretches

#: Words of a gram; a window's anchor is one of its grams.
GRAM = 6


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _units(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    # bytes.split() cuts at \x20 and \x09-\x0D.
    first = word_values(body.split())
    return first, second_values(first)


class Automaton:
    """The suffix automaton of several stretches of words."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def statistics(self, words: list[int]) -> Iterator[int]:
        """The length of the longest match that ends at each word."""
        state, size = 0, 0
        following, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word in following[state]:
                state, size = following[state][word], size + 1
            yield size

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of `word` after `state`, of that length exactly."""
        old = self.next[state][word]
        size = self.length[state] + 1
        if self.length[old] == size:
            return old
        clone = self._state(size, dict(self.next[old]), self.link[old])
        self.link[old] = clone
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new


def _matcher(length: int):
    def match(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for key, group in blocks:
            shard, flags, counts = Automaton(), [], []
            for row in group:
                words = np.frombuffer(row[5], np.int64).tolist()
                sizes = np.fromiter(shard.statistics(words), np.int64, len(words))
                seen = sizes[length - 1 :] >= length
                for a, b in zip(*(x.tolist() for x in stretches(~seen)), strict=True):
                    shard.add(words[a : b + length - 1])
                flags.append(seen)
                counts.append((~seen).astype(np.int64))
            yield key, group, flags, counts

    return match


def earlier_windows(docs: DataFrame, length: int = 20, gram: int = GRAM) -> DataFrame:
    """`did`, `rk`, `s`, `n`: stretches of `n` window starts from word `s` whose windows also start earlier."""

    def contents(body: bytes):
        values = word_values(body.split())
        return lambda pos, n: values[pos : pos + n + length - 1].tobytes()

    def values(content: bytes):
        first = np.frombuffer(content, np.uint64)
        return first, second_values(first)

    return removed_windows(keyed(docs), _units, contents, _matcher(length), values, min(gram, length), length, True)


_OUT = "did long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<s: long, e: long>>"


def _apply(length: int, texts: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    names = ["did", "n_words", "n_removed", "kept_sha256", "kept", "spans"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for did, body, cuts in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, spans, removed = body.as_py().split(), [], 0
                kept = words
                if cuts.is_valid:
                    s, n = (cuts.values.field(k).to_numpy(zero_copy_only=False) for k in ("s", "n"))
                    flags = covered(len(words), s, s + n + length - 1)
                    spans = list(zip(*(x.tolist() for x in stretches(flags)), strict=True))
                    removed, kept, at = int(flags.sum()), [], 0
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                rest = b" ".join(kept)
                row = (
                    did.as_py(), len(words), removed, hashlib.sha256(rest).hexdigest(),
                    rest.decode() if texts else None, [{"s": a, "e": b} for a, b in spans] if texts else None,
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return apply


def substring_dedup(docs: DataFrame, length: int = 20, texts: bool = True) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_removed`, `kept_sha256`, and with `texts` also `kept` and `spans` (in words)."""
    cuts = stretches_by_document(earlier_windows(docs, length))
    out = (
        keyed(docs).join(cuts, ["did", "rk"], "left").select("did", "body", "cuts")
        .mapInArrow(_apply(length, texts), _OUT)
    )
    return out.select(public_id(), "n_words", "n_removed", "kept_sha256", *(["kept", "spans"] if texts else []))
