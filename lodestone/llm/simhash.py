"""SimHash near-dedup: fingerprints of word shingles, linked at few differing bits, found by pigeonhole blocks.

A fingerprint's 64 bits are cut into five blocks. At most three differing bits leave two blocks untouched, so a close pair
agrees on one of the ten pairs of blocks: these are the join keys. Distinct fingerprints only are joined. A key that
holds more than `BUCKET` of them (a large group of near copies) is cut again by the same rule over the bits that it has not yet
fixed. After three cuts at most 15 bits are free, so no bucket can hold more than 2^15 fingerprints, whatever the size of the
corpus. In a bucket the distances are verified and each connected part is reported as a star, not as all its pairs.

Null and empty texts have the fingerprint zero. Repeated rows are documents of their own; `component_id` is the smallest id of a
group that is not null, so it is null only if all ids of a group are. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import NO_ID, Stored, keyed, public_id
from lodestone.llm.components import connected_components

#: Fingerprints that are compared in one bucket; larger buckets are cut again.
BUCKET = 1024
LEVELS = 3
SEED = 42
_AT_ONCE = 1 << 15


def fingerprint(body: bytes, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number; a bit is set if it is set in over half of the shingles' hashes."""
    words = body.lower().split()  # bytes.lower() changes A-Z only, bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    totals = np.zeros(64, np.int64)
    for at in range(0, count, _AT_ONCE):
        part = words[at : at + _AT_ONCE + shingle - 1]
        size = max(1, len(part) - shingle + 1)
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), size)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """`did`, `rk` and `fp`, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(b.as_py(), shingle) for b in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["did", "rk", "fp"])

    return keyed(docs).mapInArrow(run, "did long, rk long, fp long")


def _cut(free: list[int], distance: int) -> list[list[int]]:
    """The bits fixed by each key over the free bits: two of `distance + 2` blocks."""
    blocks = [free[i :: distance + 2] for i in range(distance + 2)]
    return [sorted(a + b) for a, b in combinations(blocks, 2)]


def masks(distance: int = 3, levels: int = LEVELS) -> list[list[int]]:
    """For each level the masks (as signed numbers) of all paths; path p at one level has the paths p * c + j at the next."""
    out, paths = [], [[]]
    for _ in range(levels):
        paths = [fixed + cut for fixed in paths for cut in _cut([b for b in range(64) if b not in fixed], distance)]
        unsigned = [sum(1 << b for b in fixed) for fixed in paths]
        out.append([m - (1 << 64) if m >> 63 else m for m in unsigned])
    return out


def _stars(values: list[int], distance: int) -> Iterator[tuple[int, int]]:
    """Links (first of a part, other) over the connected parts of a bucket."""
    if len(values) == 2:
        if ((values[0] ^ values[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance:
            yield values[0], values[1]
        return
    rest = np.array(sorted(values), np.int64)
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        frontier = seed
        while len(frontier) and len(rest):
            some, frontier = frontier[:256], frontier[256:]
            near = (np.bitwise_count((some[:, None] ^ rest[None, :]).view(np.uint64)) <= distance).any(axis=0)
            found, rest = rest[near], rest[~near]
            frontier = np.concatenate([frontier, found])
            for other in found.tolist():
                yield int(seed[0]), other


def _keys(mask: list[int], ways: int) -> Column:
    """The keys of a fingerprint that came by `path`; path p goes on as p * ways ... p * ways + ways - 1."""
    table = F.array(*[F.lit(m) for m in mask])

    def key(j: Column) -> Column:
        path = F.col("path") * ways + j
        return F.struct(path.alias("path"), F.get(table, path).bitwiseAND(F.col("fp")).alias("key"))

    return F.transform(F.sequence(F.lit(0), F.lit(ways - 1)), key)


def links(fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """`a`, `b`: links that connect all distinct fingerprints `fp` within the distance; not every close pair is a row."""
    ways = (distance + 2) * (distance + 1) // 2

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for members in batch.column(0) for pair in _stars(members.as_py(), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = fps.select("fp").distinct().withColumn("path", F.lit(0))
    out = None
    for level, mask in enumerate(masks(distance)):
        keys = _keys(mask, ways)
        rows = rows.select("fp", F.explode(keys).alias("k")).select("fp", "k.path", "k.key")
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("size")).where("size > 1")
        shared = Stored(rows.join(sizes, ["path", "key"]), "simhash-keys").df
        last = level == LEVELS - 1
        compared = shared if last else shared.where(F.col("size") <= bucket)
        found = compared.groupBy("path", "key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(verify, "a long, b long")
        out = found if out is None else out.unionByName(found)
        rows = shared.where(F.col("size") > bucket).select("fp", "path")
        if last or rows.isEmpty():
            break
    return out


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """`did`, `rk`, `fp`, `first_did`, `first_rk`: each document with the first key of its group."""
    fps = Stored(fingerprints(docs, shingle), "fingerprints").df
    key = F.struct("did", "rk")
    firsts = fps.groupBy("fp").agg(F.min(F.when(F.col("did") != NO_ID, key)).alias("first"), F.min(key).alias("any"))
    roots = connected_components(links(fps, distance))
    placed = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", "any", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.coalesce(F.min("first"), F.min("any")).alias("head"))
    named = (
        placed.select("fp", "root").join(heads, "root")
        .select("fp", F.col("head.did").alias("first_did"), F.col("head.rk").alias("first_rk"))
    )
    return fps.join(named, "fp").select("did", "rk", "fp", "first_did", "first_rk")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id`: the smallest id that is reachable over links."""
    groups = simhash_groups(docs, shingle, distance)
    return groups.select(
        public_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), public_id("first_did").alias("component_id")
    )


def simhash_dedup(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The documents, with their own columns, of which each group keeps one: the smallest id, then the smallest key.

    Equal rows are one; of groups without any id one row stays too.
    """
    heads = simhash_groups(docs, shingle, distance).select(F.col("first_did").alias("_did"), F.col("first_rk").alias("_rk")).distinct()
    keys = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_did"),
        F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))).alias("_rk"),
    ]
    return docs.select("*", *keys).join(heads, ["_did", "_rk"], "left_semi").dropDuplicates(["_did", "_rk"]).select(*docs.columns)
