"""Equal windows of fixed length in many sequences, found by local minima of rolling hashes.

A sequence is an array of unit values (bytes or word hashes). Every window of `length` units holds
`length - gram + 1` grams; the leftmost gram of the smallest hash is its anchor. The anchor depends on the
window's content alone, so equal windows have equal anchors at equal offsets. Neighbouring windows mostly share an
anchor: they form a run. Runs, not windows, are shuffled: about `2 / (length - gram + 2)` rows per unit.

A run's identity is its anchor's hash, and a second, independent hash over its content and its place around the anchor. Runs
of equal identity hold equal windows throughout. Runs that share the anchor's hash only may still share some windows.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Units that are hashed at a time; longer sequences are cut with an overlap, so that each window is in one part.
PART = 1 << 19
_INDEX = np.uint64((1 << 20) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def table(seed: int) -> np.ndarray:
    """256 values for bytes."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefix:
    """Polynomial hashes, modulo 2^64, of any stretch of an array of unit values."""

    def __init__(self, values: np.ndarray, base: int, size: int):
        up, self.down = _powers(base, size + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


BASES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def sliding_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def parts(lengths: np.ndarray, length: int):
    """Groups of stretches (sequence, first unit, end) of at most `PART` units each; windows are in one stretch each."""
    group, size = [], 0
    for i, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= length:
            end = min(n, at + PART)
            if size and size + end - at > PART:
                yield group
                group, size = [], 0
            group.append((i, at, end))
            size += end - at
            if end == n:
                break
            at = end - length + 1
    if group:
        yield group


def runs(unit_values, lengths: np.ndarray, gram: int, length: int):
    """Yields (sequence, start, windows, offset, anchor hash, content hash) as arrays.

    `unit_values(sequence, start, end)` returns two arrays of independent 64-bit unit values.
    `start` is the first window's, in units of the sequence; `offset` is the anchor's distance from it.
    """
    for group in parts(lengths, length):
        values = [unit_values(*g) for g in group]
        first, second = (np.concatenate([v[i] for v in values]) for i in (0, 1))
        sizes = np.array([e - s for _, s, e in group])
        ends = np.cumsum(sizes)
        one, two = Prefix(first, BASES[0], PART), Prefix(second, BASES[1], PART)
        hashes = one.grams(gram)
        lows = sliding_minimum((hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        anchor = (lows & _INDEX).astype(np.int64)
        valid = np.zeros(len(anchor), bool)
        for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            valid[s : e - length + 1] = True
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(change & valid)
        if not len(starts):
            continue
        last = np.ones(len(anchor), bool)
        last[:-1] = change[1:] | ~valid[1:]
        counts = np.flatnonzero(last & valid) - starts + 1
        offset = anchor[starts] - starts
        content = two.between(starts, starts + counts + length - 1)
        content = mix(content + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + counts.astype(np.uint64))
        which = np.searchsorted(ends, starts, side="right")
        sequence = np.array([g[0] for g in group])[which]
        start = starts - (ends - sizes)[which] + np.array([g[1] for g in group])[which]
        yield sequence, start, counts, offset, hashes[anchor[starts]].view(np.int64), content.view(np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `n` units lie in one of the stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]
