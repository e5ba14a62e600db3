"""Which windows of fixed length occur elsewhere, over all documents: the search that two operators share.

1. Each document's windows form runs with a common anchor (`windows.runs`); about one run per 170 bytes or per 8 words.
2. Anchors that occur once are done with: their windows are unique. Runs of equal identity are equal throughout.
3. Of the other runs that share an anchor one of each identity goes, with its content, to the task of its anchor, where
   the caller's matcher finds the windows that several of them share.

An anchor may hold a third of all rows. Equal runs are aggregated before the shuffle. An anchor with more than `BLOCK` different
runs is dealt over blocks by the hash of the run. Each block then reports its different windows, a few neighbours (a cell) a row,
with a hash of the core that all windows of the cell contain. Windows can be equal only where the cores are: cells whose core
occurs in several blocks go on, and their windows are aggregated by hash over the blocks. No run, window or partner is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored
from lodestone.llm.windows import BASES, Prefix, mix, runs, stretches

#: Different runs of one anchor that one task compares at a time, on average.
BLOCK = 1024
_RUN = "did long, rk long, pos long, n int, off int, ah long, rh long"
_HIT_SCHEMA = pa.schema([
    ("did", pa.int64()), ("rk", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("salt", pa.int32()), ("core1", pa.int64()),
    ("core2", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())),
])
_HIT = (
    "did long, rk long, s long, n long, salt int, core1 long, core2 long, h1 array<long>, h2 array<long>, c array<long>"
)


def _emit_runs(units: Callable, gram: int, length: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, rk = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sequences = [units(b.as_py()) for b in batch.column(2)]
            lengths = np.array([len(s[0]) for s in sequences], np.int64)
            for which, start, count, offset, ah, rh in runs(
                lambda i, s, e, q=sequences: (q[i][0][s:e], q[i][1][s:e]), lengths, gram, length
            ):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (did[which], rk[which], start, count.astype(np.int32), offset.astype(np.int32), ah, rh)],
                    names=["did", "rk", "pos", "n", "off", "ah", "rh"],
                )

    return emit


def _cut(contents: Callable) -> Callable:
    """Each wanted run with its content: the units of all its windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(9)]
            for did, rk, body, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
                take = contents(body.as_py())
                for w in wanted.as_py():
                    row = (w["ah"], w["salt"], w["split"], did.as_py(), rk.as_py(), w["pos"], w["n"], w["off"], take(w["pos"], w["n"]))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["ah", "salt", "split", "did", "rk", "pos", "n", "off", "content"],
            )

    return cut


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(anchor, salt, divided) and the rows (did, rk, pos, n, off, content) of each block, in their order."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for key, group in groupby(rows(), itemgetter(0, 1, 2)):
        # Rows of one key are one text: each of its runs counts once here.
        yield key, [next(same)[3:] for _, same in groupby(group, itemgetter(3, 4, 5))]


def cells(off: int, counts: np.ndarray, prefixes: tuple[Prefix, Prefix], length: int, cell: int) -> Iterator[tuple]:
    """(first window, windows, core hashes) of each cell of a run that has different windows to report.

    Cells are laid out from the anchor, so equal windows are in cells of equal number.
    """
    n = len(counts)
    for number in range((off - n + 1) // cell, off // cell + 1):
        low, high = max(0, off - cell * number - cell + 1), min(n, off - cell * number + 1)
        if low < high and counts[low:high].any():
            start = np.array([off - cell * number])
            yield low, high, [int(p.between(start, start - cell + 1 + length).view(np.int64)[0]) + number for p in prefixes]


def _match(matcher: Callable, values: Callable, length: int) -> Callable:
    cell = min(8, max(1, length // 5))

    def rows(key: tuple, group: list, repeated: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[tuple]:
        """Stretches of windows to be removed; for a divided anchor its different windows by cell, too.

        `repeated` flags each run's windows; `counts` has, at the first place of each different window, how often it occurs.
        """
        for (did, rk, pos, _, off, content), flags, count in zip(group, repeated, counts, strict=True):
            if flags.any():
                for a, b in zip(*(x.tolist() for x in stretches(flags)), strict=True):
                    yield did, rk, pos + a, b - a, None, None, None, None, None, None
            if key[2] and count.any():
                prefixes = tuple(Prefix(v, base, len(v)) for v, base in zip(values(content), BASES, strict=True))
                h1, h2 = (p.grams(length).view(np.int64) for p in prefixes)
                for low, high, core in cells(off, count, prefixes, length, cell):
                    part = slice(low, high)
                    yield did, rk, pos + low, high - low, key[1], *core, h1[part].tolist(), h2[part].tolist(), count[part].tolist()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _HIT_SCHEMA, strict=True)], schema=_HIT_SCHEMA)

        for solved in matcher(_groups(batches)):
            for row in rows(*solved):
                held.append(row)
                if len(held) >= 5000:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return match


def removed_windows(
    keyed_docs: DataFrame, units: Callable, contents: Callable, matcher: Callable, values: Callable,
    gram: int, length: int, keep_first: bool,
) -> DataFrame:
    """`did`, `rk`, `s`, `n`: stretches of `n` window starts from `s` whose windows are to be removed.

    With `keep_first` these are the windows that also start earlier, in the order of id, row key and place; else
    all that also start anywhere else. `units(body)` has two arrays of hashed unit values, `contents(body)` a
    function of (place, windows) that cuts content out, `values(content)` has the hashed unit values of content, and
    `matcher` maps blocks of an anchor to (block's key, rows, flags, counts).
    """
    found = Stored(keyed_docs.mapInArrow(_emit_runs(units, gram, length), _RUN), "window-runs")
    # Both sides of these joins are stored tables, so that Spark can divide the partitions of hot keys.
    anchors = Stored(
        found.df.groupBy("ah").agg(F.count("*").alias("members"), F.min("rh").alias("low"), F.max("rh").alias("high"))
        .where("members > 1").select("ah", (F.col("low") != F.col("high")).alias("mixed")),
        "shared-anchors",
    )
    shared = Stored(found.df.join(anchors.df, "ah"), "shared-runs")
    found.drop()
    anchors.drop()
    classes = Stored(
        shared.df.groupBy("ah", "rh", "mixed")
        .agg(F.count("*").alias("members"), F.min(F.struct("did", "rk", "pos", "n", "off")).alias("rep")),
        "run-classes",
    )
    copies = shared.df.join(classes.df.where("members > 1").select("ah", "rh", "rep"), ["ah", "rh"])
    if keep_first:
        copies = copies.where(F.struct("did", "rk", "pos", "n", "off") != F.col("rep"))
    whole = copies.select("did", "rk", F.col("pos").alias("s"), F.col("n").cast("long").alias("n"))

    mixed = classes.df.where("mixed")
    large = Stored(mixed.groupBy("ah").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large-anchors")
    wanted = (
        mixed.join(large.df, "ah", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .select(
            "rep.did", "rep.rk",
            F.struct(
                "ah", F.pmod(F.hash("rh"), F.col("blocks")).alias("salt"), (F.col("blocks") > 1).alias("split"),
                "rep.pos", "rep.n", "rep.off",
            ).alias("run"),
        )
        .groupBy("did", "rk").agg(F.collect_list("run").alias("wanted"))
    )
    cut = (
        keyed_docs.join(wanted, ["did", "rk"])
        .mapInArrow(_cut(contents), "ah long, salt int, split boolean, did long, rk long, pos long, n int, off int, content binary")
    )
    order = ["ah", "salt", "split", "did", "rk", "pos"]
    hits = Stored(
        cut.repartition("ah", "salt").sortWithinPartitions(*order).mapInArrow(_match(matcher, values, length), _HIT), "window-hits"
    )
    one = hits.df.where("salt IS NULL").select("did", "rk", "s", "n")
    divided = hits.df.where("salt IS NOT NULL")
    cores = Stored(
        divided.groupBy("core1", "core2").agg(F.min("salt").alias("low"), F.max("salt").alias("high"))
        .where("low < high").select("core1", "core2"),
        "shared-cores",
    )
    windows = Stored(
        divided.join(cores.df, ["core1", "core2"]).select("did", "rk", "s", F.posexplode(F.arrays_zip("h1", "h2", "c")))
        .select("did", "rk", (F.col("s") + F.col("pos")).alias("s"), "col.h1", "col.h2", "col.c").where("c > 0"),
        "shared-cells",
    )
    if keep_first:
        earliest = windows.df.groupBy("h1", "h2").agg(F.min(F.struct("did", "rk", "s")).alias("earliest"))
        over = windows.df.join(earliest, ["h1", "h2"]).where(F.struct("did", "rk", "s") != F.col("earliest"))
    else:
        total = windows.df.groupBy("h1", "h2").agg(F.sum("c").alias("total"))
        over = windows.df.join(total, ["h1", "h2"]).where("total > 1")
    return whole.unionByName(one).unionByName(over.select("did", "rk", "s", F.lit(1).cast("long").alias("n")))


def stretches_by_document(windows: DataFrame) -> DataFrame:
    """`did`, `rk`, `cuts`: the stretches of each document; there are fewer than it has units."""
    return windows.groupBy("did", "rk").agg(F.collect_list(F.struct("s", "n")).alias("cuts"))


def second_values(first: np.ndarray) -> np.ndarray:
    return mix(first + np.uint64(0x632BE59BD9B4E019))
