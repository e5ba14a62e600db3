"""Hashes of a text's plain words: lower-case letters, digits and all bytes from \\x80 on; A-Z count as a-z."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lodestone.llm.windows import BASES, PART, Prefix, table

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_VALUES = table(11)


#: Bodies that are hashed together.
TOGETHER = PART


def _single(part: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces begin, three bytes each: Han and kana, and Thai, Lao, Burmese and Khmer."""
    lead = (part >= 0xE3) & (part <= 0xE9)
    odd = np.flatnonzero((part == 0xE0) | (part == 0xE1))
    odd = odd[odd + 1 < len(part)]
    if len(odd):
        first, second = part[odd], part[odd + 1]
        thai = (first == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
        khmer = (first == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))
        lead[odd[thai | khmer]] = True
    return np.flatnonzero(lead)


def _parts(body: bytes, unspaced: bool) -> Iterator[tuple[int, Prefix, np.ndarray, np.ndarray]]:
    data = _LOWER[np.frombuffer(body, np.uint8)]
    at = 0
    while at < len(data):
        end = min(len(data), at + PART)
        if end < len(data):
            gaps = np.flatnonzero(~_WORD[data[at:end]]) + 1
            if not len(gaps) and unspaced:
                gaps = _single(data[at:end])
            end = at + int(gaps[-1]) if len(gaps) and gaps[-1] else end
        part = data[at:end]
        word = np.concatenate(([False], _WORD[part], [False]))
        start, stop = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
        if unspaced and part.max(initial=0) >= 0xE0:
            single = _single(part)
            cut = np.concatenate((single, np.minimum(single + 3, len(part))))
            start[cut] |= word[cut + 1]
            stop[cut] |= word[cut]
        yield at, Prefix(_VALUES[part], BASES[0], PART), np.flatnonzero(start), np.flatnonzero(stop)
        at = end


def parts(body: bytes) -> Iterator[tuple[Prefix, np.ndarray, np.ndarray]]:
    """Byte hashes and the starts and ends of the words, by parts of at most `PART` bytes (a word longer than that is cut)."""
    for _, prefix, starts, ends in _parts(body, False):
        yield prefix, starts, ends


def hashes(body: bytes, unspaced: bool = False) -> np.ndarray:
    """The words' hashes, in order. With `unspaced` each character of a script without spaces is a word."""
    return np.concatenate([np.zeros(0, np.uint64), *(p.between(s, e) for _, p, s, e in _parts(body, unspaced))])


def hashes_of_all(bodies: list[bytes], unspaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all bodies, and where those of each begin (and the last ones end); short bodies are hashed together."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(bodies), np.int64)
    at = 0
    while at < len(bodies):
        end, size = at + 1, len(bodies[at])
        while end < len(bodies) and size + len(bodies[end]) < TOGETHER // 2:
            size += len(bodies[end]) + 1
            end += 1
        if end == at + 1:
            found.append(hashes(bodies[at], unspaced))
            counts[at] = len(found[-1])
        else:
            begins = np.cumsum([0, *(len(b) + 1 for b in bodies[at:end])])
            # Of less than half a part, which is never cut.
            for _, prefix, starts, stops in _parts(b" ".join(bodies[at:end]), unspaced):
                found.append(prefix.between(starts, stops))
                counts[at:end] = np.diff(np.searchsorted(starts, begins))
        at = end
    return np.concatenate(found), np.concatenate(([0], np.cumsum(counts)))


def parts_of_all(bodies: list[bytes]) -> Iterator[tuple[Prefix, np.ndarray, np.ndarray, np.ndarray]]:
    """As `parts`, of all bodies, and the number of the body that each word is of; short bodies are hashed together."""
    at = 0
    while at < len(bodies):
        end, size = at + 1, len(bodies[at])
        while end < len(bodies) and size + len(bodies[end]) < TOGETHER // 2:
            size += len(bodies[end]) + 1
            end += 1
        begins = np.cumsum([0, *(len(b) + 1 for b in bodies[at : end - 1])])
        for _, prefix, starts, ends in _parts(b" ".join(bodies[at:end]), False):
            # Of one body there may be several parts; several bodies are less than half a part, which is never cut.
            yield prefix, starts, ends, at + np.searchsorted(begins, starts, "right") - 1 if end > at + 1 else np.full(len(starts), at)
        at = end
