"""Token-ID output: documents as token ids in Simple-8b shard files, in the order of their ids, and back.

Rows are range-partitioned by id and sorted in the partition; each task encodes its rows in turn and ends a shard after
`shard_ids` ids, so a task holds one shard, packed. Shards are files of their own (`simple8b`), written and read by Spark's own
file sources, hence on any store that Spark reaches.

White space is dropped by the tokenizers meant here, and no token spans it, so every word is encoded for itself, once for as long as
a process remembers it; `words=False` encodes texts whole, with any tokenizer. Null and empty texts have the end id only. Rows of equal id are in the
order of a hash of their text, equal rows are written as often as they occur, and a null id comes first. Of an empty table no
shard is written. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, keyed, public_id, shuffles_cleaned
from lodestone.llm.simple8b import Shard, ShardWriter

SHARD_IDS = 8_000_000
#: Words that a process remembers.
REMEMBERED = 500_000
#: Documents, or bytes, that are encoded at a time.
AT_ONCE, AT_ONCE_BYTES = 8192, 4 << 20
#: Documents whose ids are put together at a time.
GATHERED = 128
#: The rules of tokenizers whose words are cut into pieces here; fixed values.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Characters below this one (Latin letters and signs) have the same kinds in all versions of Unicode in use.
PLAIN = 0x250
_END = chr(PLAIN)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _letters_and_numbers() -> re.Pattern:
    """Cuts words of characters below `PLAIN` as `PRE_TOKENIZER` does, if they hold no apostrophe and no white space."""
    kinds = {"L": "", "N": ""}
    for i in range(PLAIN):
        kind = unicodedata.category(chr(i))[0]
        if kind in kinds:
            kinds[kind] += re.escape(chr(i))
    return re.compile(f"[{kinds['L']}]+|[{kinds['N']}]|[^{kinds['L']}{kinds['N']}]+")


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level tokenizers write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_PIECES, _BYTES = _letters_and_numbers(), _byte_characters()
_FOUR = struct.Struct("<I").pack


class Encoder:
    """Ids of texts, without special tokens, as little-endian unsigned 32-bit numbers.

    With `words` a text is taken apart at white space, which no token spans. Words that the tokenizer's rules leave as they are
    go to its model piece by piece; all others go through the whole tokenizer. Texts that may hold the string of a special
    token are encoded whole. These tokenizers lower their input, so A-Z may be lowered first.
    """

    def __init__(self, path: str, words: bool):
        self.tokenizer, self.words = _tokenizer(path), words
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.plain = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        # What is remembered: words, and their stretches of ids. It is kept in Arrow and numpy arrays, which are small.
        self.known = pa.array([], pa.string())
        self.first, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        self.turn = 0

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _word(self, word: bytes) -> bytes | None:
        """The ids of a word that the normalizer leaves as it is."""
        text = word.decode()
        if text.isascii():
            if text.isalpha():
                return self._piece(text)
        elif max(text) >= _END or "\x85" in text or "\xa0" in text or text != text.lower() or not unicodedata.is_normalized("NFC", text):
            return None
        elif text.isalpha():
            return self._piece(text)
        if "'" in text:
            return None
        return b"".join([self._piece(piece) for piece in _PIECES.findall(text)])

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return b"".join([_FOUR(t.id) for t in self.model.tokenize(spelled)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of different words among those that are known, after learning those that are not."""
        self.turn += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            more = words.take(pa.array(new))
            spelled = more.view(pa.binary()).to_pylist()
            found = [self._word(w) if self.plain else None for w in spelled]
            rest = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(rest, self._whole([spelled[i] for i in rest]), strict=True):
                found[i] = ids
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, more])
            self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(found), "<u4"))
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.turn
        return at

    def _forget(self) -> None:
        """Keeps the half that was met last."""
        if len(self.known) > REMEMBERED:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
            size = self.size[keep]
            first = np.cumsum(size) - size
            self.ids = self.ids[np.repeat(self.first[keep] - first, size) + np.arange(size.sum())]
            self.known, self.first, self.size, self.used = self.known.take(pa.array(keep)), first, size, self.used[keep]

    def _by_words(self, bodies: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without special tokens. Arrow splits, numbers the different words, and these are looked up once."""
        texts = pa.array([b.lower() for b in bodies], pa.binary()).view(pa.string())
        # It cuts at ASCII white space, which is white space to the tokenizer too; empty words have no ids.
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        places = self._places(coded.dictionary)
        first, size, ids = self.first[places], self.size[places], self.ids
        number, edges = coded.indices.to_numpy(), lists.offsets.to_numpy()
        out = []
        for at in range(0, len(bodies), GATHERED):
            bounds = edges[at : at + GATHERED + 1]
            part = number[bounds[0] : bounds[-1]]
            counts = size[part]
            edge = np.concatenate(([0], np.cumsum(counts)))
            found = ids[np.repeat(first[part] - edge[:-1], counts) + np.arange(edge[-1])]
            cuts = edge[bounds - bounds[0]].tolist()
            out += [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self._forget()
        return out

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        if not self.words:
            return [np.frombuffer(i, "<u4") for i in self._whole(bodies)]
        plain = [part for b in bodies if b"<|" not in b for part in _cut(b)]
        found = iter(self._by_words(plain) if plain else [])
        return [
            np.frombuffer(self._whole([b])[0], "<u4") if b"<|" in b else np.concatenate([next(found) for _ in _cut(b)]) for b in bodies
        ]


def _cut(body: bytes) -> list[bytes]:
    """A long text in parts that end at a white space, if there is one."""
    parts = []
    while len(body) > AT_ONCE_BYTES:
        at = max(body.rfind(b" ", 0, AT_ONCE_BYTES), body.rfind(b"\n", 0, AT_ONCE_BYTES))
        if at <= 0:
            break
        parts.append(body[:at])
        body = body[at:]
    return [*parts, body]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool = True) -> Encoder:
    """The encoder of this process; tasks that follow one another share what it remembers."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """A few rows at a time."""
    for batch in batches:
        at, size = 0, 0
        lengths = pc.binary_length(batch.column(2)).to_pylist()
        for i, n in enumerate(lengths, 1):
            size += n
            if i - at >= AT_ONCE or size >= AT_ONCE_BYTES or i == len(lengths):
                yield tuple(c.slice(at, i - at).to_pylist() for c in batch.columns[:3])
                at, size = i, 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS, words: bool = True) -> None:
    """Writes shard files below `path`, a new folder on a store that Spark reaches. `tokenizer` is a file on every machine."""
    end = np.uint32(end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(tokenizer, words).encode, ShardWriter()

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], names=["value"])

        for did, rk, bodies in _some(batches):
            for d, r, ids in zip(did, rk, encode(bodies), strict=True):
                writer.add(d, r, np.append(ids, end))
                if writer.first[-1] >= shard_ids:
                    yield shard()
                    writer = ShardWriter()
        if writer.did:
            yield shard()

    ordered = keyed(docs).repartitionByRange("did", "rk").sortWithinPartitions("did", "rk")
    # The text source writes a string's bytes as they are, and the end byte behind; one row is one file.
    shards = ordered.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    with shuffles_cleaned(docs.sparkSession):
        shards.write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`, and `ids`."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    names = ["path", "total", "did", "rk", "first", "n_tokens", "ids_crc32", "ids"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard.parse(content.as_py())
                bounds, total = shard.first.astype(np.int64), int(shard.first[-1])
                for low in range(0, len(shard.did), 256):
                    high = min(len(shard.did), low + 256)
                    base = int(bounds[low])
                    ids = shard.ids(base, int(bounds[high])).astype("<u4")
                    edges = (bounds[low : high + 1] - base).tolist()
                    each = [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                    columns = (
                        [file.as_py()] * (high - low), [total] * (high - low), shard.did[low:high], shard.rk[low:high],
                        bounds[low:high], [len(x) for x in each], [zlib.crc32(x.tobytes()) for x in each],
                        [x.astype(np.int64) if with_ids else None for x in each],
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = Stored(
        files.mapInArrow(
            unpack, "path string, total long, did long, rk long, first long, n_tokens long, ids_crc32 long, ids array<long>"
        ),
        "token-rows",
    ).df
    # One row per shard file: the sums of the shards before it.
    shards = rows.groupBy("path").agg(F.min(F.struct("did", "rk", "first")).alias("key"), F.first("total").alias("total"))
    before = Window.orderBy("key", "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("path", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    out = rows.join(starts, "path")
    return out.select(public_id(), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
