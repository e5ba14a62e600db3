"""Simple-8b: ids packed into 64-bit words, and the shard files that hold them.

A word has a selector in its upper four bits and below it as many ids, each of the selector's width, as the selector says; the
encoder takes the selector of the most ids that fit. Selector 0 is the escape: the next word is one id of 60 bits or more, whole;
such an id has upper bits set, so it cannot be taken for an escape. Blocks of `BLOCK_IDS` ids begin at a word of their own.

A shard file is, all little-endian: the magic; four unsigned 64-bit numbers (documents, ids, blocks, words); the
documents' ids and keys (signed 64-bit each); the documents' first ids and the total (unsigned 64-bit); the blocks' first
words and the total (unsigned 64-bit); the words; and the end byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ids in a word and their width, by selector from 1; fixed values of the format.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK_IDS = 1024
MAGIC = b"LDSTOK8B"
END = b"\n"
_SHIFT = np.uint64(60)
_COUNTS = np.array([1, *(c for c, _ in LAYOUTS)], np.int64)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For every place the selector of the most ids from there that fit in one word of their block."""
    n = len(ids)
    left = np.minimum(BLOCK_IDS - np.arange(n) % BLOCK_IDS, np.arange(n, 0, -1))
    out = np.zeros(n, np.uint8)
    largest = int(ids.max()) if n else 0
    narrow = ids.astype(np.uint32) if largest < 1 << 32 else ids
    for selector, (count, width) in reversed(list(enumerate(LAYOUTS, 1))):
        if not largest >> width:
            out[left >= count] = selector
            continue
        fitting = np.flatnonzero(narrow < 1 << width) if width < 32 or narrow.dtype == np.uint64 else np.arange(n)
        if len(fitting) >= count:
            # A run of places in a row is as long as their difference says.
            starts = fitting[: len(fitting) - count + 1]
            starts = starts[fitting[count - 1 :] - starts == count - 1]
            out[starts[left[starts] >= count]] = selector
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the first word of each block and their number."""
    ids = np.ascontiguousarray(ids, np.uint64)
    selectors = _selectors(ids)
    step = _COUNTS[selectors]
    blocks = -(-len(ids) // BLOCK_IDS)
    # All blocks are walked at the same time.
    at = np.arange(blocks) * BLOCK_IDS
    end = np.minimum(at + BLOCK_IDS, len(ids))
    taken = []
    while len(at):
        taken.append(at)
        at = at + step[at]
        open_ = at < end
        at, end = at[open_], end[open_]
    starts = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    chosen = selectors[starts]
    size = 1 + (chosen == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector, (count, width) in enumerate(LAYOUTS, 1):
        which = np.flatnonzero(chosen == selector)
        if len(which):
            packed = np.full(len(which), selector, np.uint64) << _SHIFT
            for i in range(count):
                packed |= ids[starts[which] + i] << np.uint64(i * width)
            words[place[which]] = packed
    escaped = np.flatnonzero(chosen == 0)
    words[place[escaped] + 1] = ids[starts[escaped]]
    first = np.searchsorted(starts, np.arange(blocks) * BLOCK_IDS)
    return words, np.append(place[first], len(words)).astype(np.uint64)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole words, from a block's first word to another's."""
    selectors = (words >> _SHIFT).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[1:] = selectors[:-1] == 0
    counts = np.where(raw, 0, _COUNTS[np.minimum(selectors, len(LAYOUTS))])
    place = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, width) in enumerate(LAYOUTS, 1):
        which = np.flatnonzero((selectors == selector) & ~raw)
        mask = np.uint64((1 << width) - 1)
        for i in range(count if len(which) else 0):
            ids[place[which] + i] = words[which] >> np.uint64(i * width) & mask
    escapes = np.flatnonzero((selectors == 0) & ~raw)
    ids[place[escapes]] = words[escapes + 1]
    return ids


@dataclass
class Shard:
    """A shard file's tables; ids are decoded by blocks."""

    did: np.ndarray
    rk: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    words: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC or data[-1:] != END:
            raise ValueError("not a token shard, or not whole")
        docs, _, blocks, words = np.frombuffer(data, "<u8", 4, 8).tolist()
        at, parts = 40, []
        for kind, size in (("<i8", docs), ("<i8", docs), ("<u8", docs + 1), ("<u8", blocks + 1), ("<u8", words)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += 8 * size
        if at + 1 != len(data):
            raise ValueError("a token shard of a wrong length")
        return cls(*parts)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from one place to another; only the blocks that hold them are decoded."""
        low, high = start // BLOCK_IDS, -(-end // BLOCK_IDS)
        part = decode(self.words[int(self.blocks[low]) : int(self.blocks[high])]) if high > low else np.zeros(0, np.uint64)
        return part[start - low * BLOCK_IDS : end - low * BLOCK_IDS]


class ShardWriter:
    """Collects documents; ids are packed as soon as some blocks are full."""

    FLUSH = 256 * BLOCK_IDS

    def __init__(self):
        self.did: list[int] = []
        self.rk: list[int] = []
        self.first = [0]
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.words: list[bytes] = []
        self.blocks: list[np.ndarray] = []
        self.size = 0

    def add(self, did: int, rk: int, ids: np.ndarray) -> None:
        self.did.append(did)
        self.rk.append(rk)
        self.first.append(self.first[-1] + len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.FLUSH:
            self._pack(self.waiting // BLOCK_IDS * BLOCK_IDS)

    def _pack(self, count: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        for at in range(0, count, self.FLUSH):
            words, blocks = encode(ids[at : min(count, at + self.FLUSH)])
            self.words.append(words.astype("<u8").tobytes())
            self.blocks.append(blocks[:-1] + np.uint64(self.size))
            self.size += len(words)
        self.open, self.waiting = [ids[count:].copy()], len(ids) - count

    def close(self) -> bytes:
        """The file but for its end byte."""
        self._pack(self.waiting)
        blocks = np.append(np.concatenate([np.zeros(0, np.uint64), *self.blocks]), np.uint64(self.size))
        head = np.array([len(self.did), self.first[-1], len(blocks) - 1, self.size], "<u8")
        tables = [head, np.array(self.did, "<i8"), np.array(self.rk, "<i8"), np.array(self.first, "<u8"), blocks.astype("<u8")]
        return b"".join([MAGIC, *(t.tobytes() for t in tables), *self.words])
