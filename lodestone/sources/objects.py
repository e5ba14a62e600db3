"""Files that hold one JSON object each, read by byte ranges: the items of the arrays below the object's own keys, `{key: [item, ...], ...}`.

Spark's text source splits a file at closing braces, which every such object has in plenty, so a large file is read by many tasks. What
a brace means depends on what came before, so there are two passes: the first says for each range how depth changes over it and whether a
string is open at its end, if one was open at its start and if not; these are put together in the order of ranges, a row each. The second
pass starts each range in its true state and cuts it into items. Items that ranges cut are joined from their pieces, and a range
whose first items belong to an array that was opened before takes its key from there.

No row holds more than one item. Values of other kinds than arrays, items that are nothing but white space, and the braces of no object are
left out. A key that itself holds a closing brace is read if its range holds it whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.session import kept, share_package

BRACE = b"}"
_OPEN, _CLOSE, _QUOTE, _ESCAPE, _COMMA = (0x7B, 0x5B), (0x7D, 0x5D), 0x22, 0x5C, 0x2C
_RANGE = "file string, start long"
# What a row of the second pass is: an item, its beginning, its middle, its end, or the opening of a value.
WHOLE, FIRST, MIDDLE, LAST, OPENED = range(5)
_PIECE = f"{_RANGE}, seq long, kind int, key string, in_array boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", BRACE.decode()).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """Bytes of each range, batch by batch; each begins behind a brace or at the start of the file, so no escape is open there."""
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        values = batch.column("value").to_pylist()
        at = 0
        for end in range(1, len(values) + 1):
            if end == len(values) or starts[end] != starts[at] or files[end] != files[at]:
                yield (files[at], starts[at]), np.frombuffer(BRACE.join([*values[at:end], b""]), np.uint8)
                at = end


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where strings begin and end: quotes behind an even number of backslashes."""
    at = np.flatnonzero(data == _QUOTE)
    plain = np.flatnonzero(data != _ESCAPE)
    before = np.searchsorted(plain, at) - 1
    run = at - 1 - np.where(before >= 0, plain[before], -1)
    return at[run % 2 == 0]


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quotes, and places, changes of depth and number of quotes before, of brackets and commas."""
    quotes = _quotes(data)
    change = np.zeros(256, np.int64)
    change[list(_OPEN)], change[list(_CLOSE)] = 1, -1
    places = np.flatnonzero((change[data] != 0) | (data == _COMMA))
    return quotes, places, change[data[places]], np.searchsorted(quotes, places)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: quotes (odd or even), and change of depth if no string is open at its start, or if one is."""
    current, sums = None, [0, 0, 0]

    def row():
        arrays = [pa.array([current[0]]), pa.array([current[1]], pa.int64()), *(pa.array([s], pa.int64()) for s in sums)]
        return pa.RecordBatch.from_arrays(arrays, ["file", "start", "quotes", "closed", "open"])

    for place, data in _ranges(batches):
        if place != current:
            if current is not None:
                yield row()
            current, sums = place, [0, 0, 0]
        quotes, _, change, before = _structure(data)
        outside = (before + sums[0]) % 2 == 0
        sums = [(sums[0] + len(quotes)) % 2, sums[1] + int(change[outside].sum()), sums[2] + int(change[~outside].sum())]
    if current is not None:
        yield row()


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the start of each range, from those before it in its file."""
    file, inside, depth = None, 0, 0
    for batch in batches:
        found = []
        for name, quotes, closed, opened in zip(*(batch.column(c).to_pylist() for c in ("file", "quotes", "closed", "open")), strict=True):
            if name != file:
                file, inside, depth = name, 0, 0
            found.append((bool(inside), depth))
            depth += opened if inside else closed
            inside = (inside + quotes) % 2
        columns = [pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), *columns], ["file", "start", "inside", "depth"])


class _Cutter:
    """Cuts the bytes of one range into items."""

    def __init__(self, place: tuple[str, int], inside: bool, depth: int):
        self.place, self.inside, self.depth = place, int(inside), depth
        self.rows: list[tuple] = []
        self.seq = 0
        # What is known of the value that is open: its key and whether it is an array. Of one opened before, nothing is.
        self.key, self.in_array = None, None
        self.text: list[bytes] = []
        self.begun = depth < 2
        self.top = b""

    def row(self, kind: int, text: str | None) -> None:
        self.rows.append((*self.place, self.seq, kind, self.key, self.in_array, text))
        self.seq += 1

    def item(self, piece: bytes) -> None:
        text = b"".join([*self.text, piece]).decode()
        self.text = []
        if self.in_array is not False:
            # The piece of an item that began before is its end, whatever it holds.
            if not self.begun:
                self.row(LAST, text)
            elif text.strip():
                self.row(WHOLE, text)
        self.begun = True

    def add(self, data: np.ndarray) -> None:
        raw = data.tobytes()
        quotes, places, change, before = _structure(data)
        outside = (before + self.inside) % 2 == 0
        places, change = places[outside], change[outside]
        depths = self.depth + np.cumsum(change)
        earlier = depths - change
        cut = ((change == 0) & (depths == 2)) | ((change > 0) & (depths == 2)) | ((change < 0) & (depths == 1))
        at = 0
        depth = self.depth
        for place, step, after in zip(places[cut].tolist(), change[cut].tolist(), depths[cut].tolist(), strict=True):
            if step > 0:
                names = self.top + raw[at:place]
                self.key, self.in_array, self.top = _last_string(names), raw[place] == _OPEN[1], b""
                self.row(OPENED, None)
                self.begun = True
            else:
                self.item(raw[at:place])
            at, depth = place + 1, after
            if after == 1:
                self.key = self.in_array = None
        rest = raw[at:]
        if len(depths):
            self.depth = int(depths[-1])
        if depth >= 2:
            if self.in_array is not False:
                self.text.append(rest)
        else:
            self.top += rest
        self.inside = (self.inside + len(quotes)) % 2

    def end(self) -> None:
        """What is left at the end of the range goes on in the next one."""
        if self.depth >= 2 and self.in_array is not False:
            self.row(FIRST if self.begun else MIDDLE, b"".join(self.text).decode())


def _last_string(text: bytes) -> str | None:
    """The last JSON string of some text between values."""
    quotes = _quotes(np.frombuffer(text, np.uint8))
    return json.loads(text[quotes[-2] : quotes[-1] + 1]) if len(quotes) > 1 else None


def _cut(states: dict[tuple[str, int], tuple[bool, int]]):
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter: _Cutter | None = None
        for place, data in _ranges(batches):
            if cutter is None or place != cutter.place:
                if cutter is not None:
                    cutter.end()
                    if cutter.rows:
                        yield table(cutter.rows)
                cutter = _Cutter(place, *states[place])
            cutter.add(data)
            if cutter.rows:
                yield table(cutter.rows)
                cutter.rows = []
        if cutter is not None:
            cutter.end()
            if cutter.rows:
                yield table(cutter.rows)

    return work


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `key`, `item`: the items, as JSON text, of every array below an object's own keys; a file without any is not seen."""
    share_package(spark)
    lines = _lines(spark, path)
    summaries = lines.mapInArrow(_summaries, f"{_RANGE}, quotes long, closed long, open long")
    in_order = kept(summaries, "ranges").repartition("file").sortWithinPartitions("file", "start")
    states = in_order.mapInArrow(_states, f"{_RANGE}, inside boolean, depth long")
    # A row for each range of some 128 MB: fewer bytes than the list of splits that the driver holds and sends out in any case.
    known = {(r["file"], r["start"]): (r["inside"], r["depth"]) for r in states.collect()}
    pieces = kept(lines.mapInArrow(_cut(known), _PIECE), "pieces")
    # The value that is open at the end of each range, for those behind it that open none before their first item.
    last = pieces.where(F.col("kind") == OPENED).groupBy("file", "start").agg(F.max_by(F.struct("key", "in_array"), "seq").alias("last"))
    ranges = spark.createDataFrame([k for k in known], _RANGE) if known else spark.createDataFrame([], _RANGE)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = ranges.join(last, ["file", "start"], "left").withColumn("before", F.last("last", ignorenulls=True).over(before)).drop("last")
    named = pieces.where(F.col("kind") != OPENED).join(F.broadcast(opened), ["file", "start"])
    named = named.withColumns({c: F.when(F.col("in_array").isNull(), F.col(f"before.{c}")).otherwise(F.col(c)) for c in ("key", "in_array")})
    named = named.where("in_array")
    whole = named.where(F.col("kind") == WHOLE).select("file", "key", F.col("text").alias("item"))
    # A beginning, middles and an end, at most two pieces for each range.
    cut_up = named.where(F.col("kind") != WHOLE)
    running = Window.partitionBy("file").orderBy("start", "seq")
    cut_up = cut_up.withColumn("item", F.count_if(F.col("kind") == FIRST).over(running))
    place = F.struct("start", "seq", "text", "key")
    joined = cut_up.groupBy("file", "item").agg(F.array_sort(F.collect_list(place)).alias("p")).select(
        "file", F.col("p")[0]["key"].alias("key"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("item")
    )
    return whole.unionByName(joined.where(F.length(F.trim("item", F.lit(" \t\r\n"))) > 0))
