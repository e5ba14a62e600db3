"""SentencePiece encoding and decoding of whole texts, in vectorised merge rounds.

Many texts at a time are one flat array of code points, cut into words wherever no piece of the model holds the two characters on
either side: no merge can pass such a place, so words are encoded by themselves, each different one once. All words are merged
together: a round finds the best pair of every word by a segmented minimum over ranks, merges its leftmost occurrences at once, and takes
words without a pair out. Occurrences behind one that made a better pair wait for the next round, so the merges are those of the
one-by-one rule (best score first, then leftmost), for every model of this kind.

Null and empty texts have the begin and end ids only and decode to an empty text. A text of any length is taken in parts of about
`PART` characters, cut between words, so memory is bounded by a word without such a place. Bytes that are no UTF-8 become U+FFFD. Equal rows
and ties of `doc_id` are rows of their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_bytes

#: Characters that are encoded together.
PART = 1 << 20
SPACE = "▁"
REPLACEMENT = "�".encode()
#: How the unknown piece is spelled; a fixed value.
UNKNOWN = " ⁇ ".encode()
_NONE = np.iinfo(np.int32).max
ENCODED = "doc_id long, ids binary, decoded binary"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialised message; only whole numbers and strings are read."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def _normalizer(model: bytes) -> dict[int, object]:
    """The normaliser's settings by field number: 2 character map, 3 dummy prefix, 4 extra white space, 5 escaped white space."""
    for field, value in _fields(model):
        if field == 3:
            return dict(_fields(value))
    return {}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches of a flat array, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """A model's pieces, and the pairs of them that make another one."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        rules = _normalizer(model)
        size = sp.get_piece_size()
        kinds = [(sp.is_control(i), sp.is_unknown(i), sp.is_byte(i)) for i in range(size)]
        plain = [i for i in range(size) if not any(kinds[i])]
        if rules.get(2) or rules.get(3, 1) != 1 or rules.get(4, 1) != 0 or rules.get(5, 1) != 1:
            raise ValueError("only models without a character map, with a dummy prefix and all white space")
        if sum(k[2] for k in kinds) != 256 or any(sp.is_unused(i) for i in plain):
            raise ValueError("only models with byte pieces and without unused ones")
        self.size, self.begin, self.end = size, sp.bos_id(), sp.eos_id()
        names = {sp.id_to_piece(i): i for i in plain}
        levels = {s: n for n, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs, beside, self.letters = [], set(), {}
        for name, i in names.items():
            if len(name) == 1:
                self.letters[ord(name)] = i
            beside.update(zip(name, name[1:], strict=False))
            for cut in range(1, len(name)):
                left, right = names.get(name[:cut]), names.get(name[cut:])
                if left is not None and right is not None:
                    pairs.append((left * size + right, levels[sp.get_score(i)], i))
        table = np.array(sorted(pairs) or [(-1, _NONE, 0)], np.int64)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        # Characters that stand beside another one in some piece have a class of their own; the others have class 0.
        classes = {c: n + 1 for n, c in enumerate(sorted({c for pair in beside for c in pair}))}
        self.classes = np.zeros(0x110000, np.int16)
        self.joined = np.zeros((len(classes) + 1, len(classes) + 1), bool)
        for c, n in classes.items():
            self.classes[ord(c)] = n
        for a, b in beside:
            self.joined[classes[a], classes[b]] = True
        #: The piece of a character, or beyond all pieces the character itself.
        self.symbols = np.arange(0x110000, dtype=np.int64) + size
        for c, i in self.letters.items():
            self.symbols[c] = i
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        spelled = [self._spelled(sp, i, kinds[i]) for i in range(size)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.control = np.array([k[0] for k in kinds])
        self.is_byte = np.array([k[2] for k in kinds])
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for n, i in names.items() if n.startswith(SPACE)]] = True

    @staticmethod
    def _spelled(sp, i: int, kind: tuple[bool, bool, bool]) -> bytes:
        control, unknown, byte = kind
        if byte:
            return bytes([int(sp.id_to_piece(i)[3:5], 16)])
        return b"" if control else UNKNOWN if unknown else sp.id_to_piece(i).replace(SPACE, " ").encode()

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that each pair makes (`_NONE`: none), and that piece."""
        keys = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE), self.merged[at]

    def merge(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, with their words; `words` numbers the word of each symbol and never falls."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank, made = self.ranked(symbols[:-1], symbols[1:])
            rank = np.append(np.where(words[:-1] == words[1:], rank, _NONE), np.int32(_NONE))
            made = np.append(made, 0)
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            sizes = np.diff(np.append(first, len(words)))
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best != _NONE, sizes)
            if not live.all():
                done.append((symbols[~live], words[~live]))
                symbols, words, rank, made = symbols[live], words[live], rank[live], made[live]
                if not len(symbols):
                    break
                sizes, best = sizes[best != _NONE], best[best != _NONE]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of occurrences that overlap, every other one, from the left.
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            at = at[self._undisturbed(symbols, words, rank, made, at)]
            symbols = symbols.copy()
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, words = symbols[keep], words[keep]
        if not done:
            return symbols, words
        symbols, words = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def _undisturbed(self, symbols, words, rank, made, at) -> np.ndarray:
        """Which occurrences the one-by-one rule merges before anything else: up to the first, in a word, that makes a pair as good."""
        after_merge = np.concatenate(([False], np.diff(at) == 2))
        before = np.maximum(at - 1, 0)
        left = np.where(after_merge, np.concatenate(([0], made[at[:-1]])), symbols[before])
        left_word = words[np.where(after_merge, np.concatenate(([0], at[:-1])), before)]
        behind = np.minimum(at + 2, len(symbols) - 1)
        a, _ = self.ranked(left, made[at])
        b, _ = self.ranked(made[at].astype(np.int64), symbols[behind])
        word = words[at]
        better = ((a <= rank[at]) & (at > 0) & (left_word == word)) | ((b <= rank[at]) & (at + 2 < len(symbols)) & (words[behind] == word))
        seen = np.cumsum(better) - better
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        return seen == np.repeat(seen[first], np.diff(np.append(first, len(word))))

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether a word may start at each character (the first one: yes)."""
        kind = self.classes[points]
        return np.concatenate(([True], ~self.joined[kind[:-1], kind[1:]]))

    def encode_points(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several stretches of code points, which begin at `starts`, and the number of ids of each."""
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        cut = self.cuts(points)
        cut[starts[starts < len(points)]] = True
        first = np.flatnonzero(cut)
        sizes = np.diff(np.append(first, len(points)))
        kind, example = self._different(points, first, sizes)
        taken = spread(first[example], sizes[example])
        symbols, words = self.merge(self.symbols[points[taken]], np.repeat(np.arange(len(example)), sizes[example]))
        symbols, words = self._with_bytes(symbols, words)
        count = np.bincount(words, minlength=len(example))
        ids = symbols[spread((np.cumsum(count) - count)[kind], count[kind])]
        per_word = np.concatenate(([0], np.cumsum(count[kind])))
        return ids, np.diff(per_word[np.searchsorted(first, np.append(starts, len(points)))])

    @staticmethod
    def _different(points: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which different word each word is, and a word as an example of each. Words are grouped by hash and then compared."""
        inside = np.arange(len(points)) - np.repeat(first, sizes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
            mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            code = np.add.reduceat(mixed * power[inside], first)
        _, example, kind = np.unique(code, return_index=True, return_inverse=True)
        other = np.minimum(np.repeat(first[example][kind], sizes) + inside, len(points) - 1)
        if np.array_equal(sizes[example][kind], sizes) and np.array_equal(points[other], points):
            return kind, example
        every = np.arange(len(first))
        return every, every

    def _with_bytes(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, words
        points = symbols[odd] - self.size
        size = np.ones(len(symbols), np.int64)
        size[odd] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.repeat(np.arange(len(symbols)), size)
        out, words = symbols[place], words[place]
        spelled = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[out >= self.size] = self.bytes[spelled]
        return out, words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, between the begin and the end id, as little-endian unsigned 32-bit numbers."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for parts, owners in self._parts(texts):
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            ids, sizes = self.encode_points(np.concatenate(parts), starts)
            for owner, piece in zip(owners, np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1]), strict=True):
                found[owner].append(piece)
        edge = np.array([self.begin], "<u4"), np.array([self.end], "<u4")
        return [np.concatenate([edge[0], *pieces, edge[1]]) for pieces in found]

    def _parts(self, texts: list[str]) -> Iterator[tuple[list[np.ndarray], list[int]]]:
        """Code points of texts, or of parts of long ones that are cut between words, about `PART` together, with their texts."""
        parts: list[np.ndarray] = []
        owners: list[int] = []
        waiting = 0
        for owner, text in enumerate(texts):
            if not text:
                continue
            points = np.frombuffer((SPACE + text.replace(" ", SPACE)).encode("utf-32-le"), np.uint32)
            at = 0
            while at < len(points):
                end, look = min(len(points), at + PART), PART
                while end < len(points):
                    places = np.flatnonzero(self.cuts(points[at : end + 1])[1:])
                    if len(places):
                        end = at + int(places[-1]) + 1
                        break
                    look *= 2
                    end = min(len(points), at + look)
                parts.append(points[at:end])
                owners.append(owner)
                waiting += end - at
                at = end
                if waiting >= PART:
                    yield parts, owners
                    parts, owners, waiting = [], [], 0
        if parts:
            yield parts, owners

    def decode(self, documents: list[np.ndarray]) -> list[bytes]:
        """The text of each list of ids, as UTF-8."""
        ids = np.concatenate([np.zeros(0, np.int64), *documents]).astype(np.int64)
        sizes = self.sizes[ids]
        spelled = self.spelled[spread(self.starts[ids], sizes)].tobytes()
        place = np.concatenate(([0], np.cumsum(sizes)))
        odd = np.concatenate(([0], np.cumsum(self.is_byte[ids])))
        texts, at = [], 0
        for own in documents:
            end = at + len(own)
            some = ids[at:end]
            text = spelled[place[at] : place[end]]
            if odd[end] > odd[at] and not self._sound(some, text):
                text = self._repaired(some)
            # The first piece that shows has the dummy prefix.
            shown = some[: 8] if len(some) and not self.control[some[:8]].all() else some
            shown = shown[~self.control[shown]]
            texts.append(text[1:] if len(shown) and self.spaced[shown[0]] else text)
            at = end
        return texts

    def _sound(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the bytes of byte pieces are whole characters: the text is, and no piece without a text parts its bytes."""
        inner = self.control[ids]
        if inner[1:-1].any():
            return False
        try:
            text.decode()
        except UnicodeDecodeError:
            return False
        return True

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces are read by themselves; each byte that belongs to no character is U+FFFD."""
        byte = self.is_byte[ids]
        edges = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        out = []
        for start, end in zip(edges, np.append(edges[1:], len(ids)), strict=True):
            run = ids[start:end]
            text = self.spelled[spread(self.starts[run], self.sizes[run])].tobytes()
            while byte[start]:
                try:
                    text.decode()
                    break
                except UnicodeDecodeError as error:
                    out += [text[: error.start], REPLACEMENT]
                    text = text[error.start + 1 :]
            out.append(text)
        return b"".join(out)


@cache
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_and_decode(docs: DataFrame, model_path: str, decoded: bool = True) -> DataFrame:
    """`doc_id`, `ids` (little-endian unsigned 32-bit numbers, with begin and end ids) and `decoded` (UTF-8) of each whole text.

    The model file is read where the plan is made and goes to the executors once.
    """
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for batch in batches:
            for some in _bounded(batch):
                texts = [t.decode(errors="replace") for t in some.column("body").to_pylist()]
                ids = pieces.encode(texts)
                out = pa.array(pieces.decode(ids) if decoded else [None] * len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), out],
                    ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(work, ENCODED)


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `PART` bytes of text each."""
    ends = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + PART, side="right")))
        yield batch.slice(start, end - start)
        start = end


def decode_ids(rows: DataFrame, model_path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`decoded` (UTF-8) of lists of ids, given as arrays of whole numbers; null and empty lists give an empty text."""
    model = rows.sparkSession.sparkContext.broadcast(_read(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pieces.decode(lists), pa.binary())], ["doc_id", "decoded"])

    chosen = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids).cast("array<long>").alias("ids"))
    return chosen.mapInArrow(work, "doc_id long, decoded binary")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256` of each document."""
    return encode_and_decode(docs, model_path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
