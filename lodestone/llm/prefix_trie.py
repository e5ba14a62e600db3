"""Trie of conversation prefixes, from adaptive radix trees in the tasks (`radix`).

A turn's id is a 16-byte big-endian number, the first half of the SHA-256 of its role and text. Rows are sorted into ranges over all tasks and
packed into stretches of ids, so neither a long conversation nor one of many copies is ever gathered in a task. A node of the trie has
a key that is the exclusive or of a hash of every (depth, id) on its way, so a stretch knows its nodes' keys from one value, the key
before it. Each task puts its stretches in radix trees and gives one row for each node of them, as a partial aggregation; the
nodes are then summed by key. So a prefix of a third of all conversations is a row of each task.

Sums over a subtree need no walk over depths: they are sums over members. What a subtree's nodes hold together, each once, is what its
members own, where a conversation owns the nodes of which it is the smallest member, which are the last ones of its way; and every
leaf has one owner. A second pass of trees adds that up.

Rows without `conv_id` take no part. Null roles and texts are empty, a null turn comes first, rows of one turn go by the id of role and
text, and equal rows are turns of their own. Conversations without turns are members of the root. A very long text is a value of one row
until it is hashed. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored
from lodestone.llm.ordered import chained_sha256, ranged
from lodestone.llm.radix import WIDTH, Tree

#: Turns of a stretch.
TURNS = 256
#: Turns that a task's trees hold before their nodes go on.
HELD = 1 << 18
#: Members of a node whose ids are put together for its digest.
LISTED = 1 << 15
#: Groups of conversations that share first turns, and most such turns plus 1.
FAMILY, SHARED = 5, 9
_KEY = ["conv_id", "part", "seq"]
_PACKED = "conv_id long, part int, seq long, ids binary, sizes array<long>"
_NODE = "kind int, key binary, parent binary, depth long, conv_id long, count long, total long"
_ROOT = bytes(WIDTH)


def _packed(conversations: DataFrame, turns: int) -> DataFrame:
    """Stretches of at most `turns` turns of a conversation, in the order of (part, seq)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH).alias("id"), F.octet_length(text).cast("long").alias("size"),
        # Only equal rows differ by it, so that they need not stay together.
        F.rand(1).alias("salt"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            sizes = batch.column("size").to_numpy()
            ids = np.array(batch.column("id").to_pylist(), f"S{WIDTH}") if len(conv) else np.zeros(0, f"S{WIDTH}")
            edges = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1]))) if len(conv) else []
            out = []
            for start, end in zip(edges, [*edges[1:], len(conv)], strict=True):
                one = int(conv[start]), ids[start:end].tobytes(), sizes[start:end].tolist()
                if held and held[0] == one[0]:
                    held = one[0], held[1] + one[1], held[2] + one[2]
                else:
                    if held:
                        out.append(held)
                    held = one
                while len(held[2]) >= turns:
                    out.append((held[0], held[1][: WIDTH * turns], held[2][:turns]))
                    held = held[0], held[1][WIDTH * turns :], held[2][turns:]
                if not held[2]:
                    held = None
            if out:
                yield _stretches(out, part, seq)
                seq += len(out)
        if held:
            yield _stretches([held], part, seq)

    return ranged(rows, "conv_id", "turn", "id", "salt").select("conv_id", "id", "size").mapInArrow(work, _PACKED)


def _stretches(rows: list[tuple[int, bytes, list[int]]], part: int, seq: int) -> pa.RecordBatch:
    conv, ids, sizes = zip(*rows, strict=True)
    arrays = [pa.array(conv, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(range(seq, seq + len(rows)), pa.int64())]
    arrays += [pa.array(ids, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, [*_KEY, "ids", "sizes"])


def _rebuilt(packed: DataFrame) -> DataFrame:
    """Stretches of the rebuilt conversations: `above` turns come before one, `last` is the one in which the conversation ends."""
    in_order = Window.partitionBy("conv_id").orderBy("part", "seq")
    slim = packed.select(*_KEY, F.size("sizes").cast("long").alias("n"))
    slim = slim.withColumns({
        "start": F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "turns": F.sum("n").over(Window.partitionBy("conv_id")),
    })
    first = slim.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("start") < SHARED - 1)).select(*_KEY, "start")
    room = (SHARED - 1 - F.col("start")).cast("int")
    pieces = packed.join(first, _KEY).select(
        "conv_id", F.struct("start", F.substring("ids", F.lit(1), WIDTH * room).alias("ids"), F.slice("sizes", F.lit(1), room).alias("sizes")).alias("p")
    )
    heads = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        F.col("conv_id").alias("family"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("head"),
        F.flatten(F.transform("p", lambda x: x["sizes"])).alias("head_sizes"),
    )
    here = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    family = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    info = slim.withColumns({"family": family, "h": here}).join(heads, "family", "left")
    info = info.withColumn("taken", F.least("h", F.coalesce(F.size("head_sizes"), F.lit(0)).cast("long")))
    at_start = F.col("start") == 0
    taken = F.when(at_start, F.col("taken")).otherwise(0).cast("int")
    info = info.select(
        *_KEY, "start",
        F.greatest(F.lit(0).cast("long"), F.least("n", F.col("h") - F.col("start"))).cast("int").alias("cut"),
        F.when(at_start, 0).otherwise(F.col("taken") + F.greatest("start", "h") - F.col("h")).cast("long").alias("above"),
        (F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("turns") - F.col("h"))).alias("depth"),
        (F.col("turns") > F.col("n")).alias("cut_up"),
        F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), WIDTH * taken).alias("head"),
        F.slice(F.coalesce("head_sizes", F.array().cast("array<long>")), F.lit(1), taken).alias("head_sizes"),
    )
    rest = F.size("sizes") - F.col("cut")
    whole = packed.join(info, _KEY).select(
        *_KEY, "start", "above", "depth", "cut_up",
        F.concat("head", F.substring("ids", WIDTH * F.col("cut") + 1, WIDTH * rest)).alias("ids"),
        F.concat("head_sizes", F.slice("sizes", F.col("cut") + 1, rest)).alias("sizes"),
    )
    # Of a conversation without turns one empty stretch stays, as a member of the root.
    whole = whole.where((F.size("sizes") > 0) | ((F.col("start") == 0) & (F.col("depth") == 0)))
    return whole.withColumn("last", F.col("above") + F.size("sizes") == F.col("depth")).drop("start", "depth")


def _step(depth: int, turn: bytes) -> int:
    return int.from_bytes(blake2b(turn + depth.to_bytes(8, "big"), digest_size=WIDTH).digest(), "big")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exclusive or over each stretch's turns, in two halves."""
    for batch in batches:
        high, low = [], []
        for above, ids in zip(batch.column("above").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            mark = 0
            for i in range(0, len(ids), WIDTH):
                mark ^= _step(above + i // WIDTH + 1, ids[i : i + WIDTH])
            raw = mark.to_bytes(WIDTH, "big")
            high.append(int.from_bytes(raw[:8], "big", signed=True))
            low.append(int.from_bytes(raw[8:], "big", signed=True))
        keys = [batch.column(c) for c in (*_KEY, "size")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(high, pa.int64()), pa.array(low, pa.int64())], [*_KEY, "size", "high", "low"])


def _connected(stretches: DataFrame) -> DataFrame:
    """Each stretch with the key of the node before it (`high`, `low`), and the bytes that follow in its conversation (`tail`)."""
    alone = stretches.where("not cut_up").withColumns({c: F.lit(0).cast("long") for c in ("high", "low", "tail")})
    several = stretches.where("cut_up")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("size")
    marks = several.select(*_KEY, "above", "ids", size).mapInArrow(_marks, "conv_id long, part int, seq long, size long, high long, low long")
    in_order = Window.partitionBy("conv_id").orderBy("part", "seq")
    before, behind = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    places = marks.select(
        *_KEY, F.coalesce(F.bit_xor("high").over(before), zero).alias("high"), F.coalesce(F.bit_xor("low").over(before), zero).alias("low"),
        F.coalesce(F.sum("size").over(behind), zero).alias("tail"),
    )
    return alone.unionByName(several.join(places, _KEY))


class _Trees:
    """Radix trees of a task's stretches, one for each node that stretches start from, and the sizes of their turns."""

    def __init__(self, owned: bool):
        self.owned, self.turns = owned, 0
        self.trees: dict[tuple[int, bytes], Tree] = {}
        self.sizes: dict[bytes, int] = {}

    def tree(self, above: int, high: int, low: int, ids: bytes, sizes: list[int]) -> Tree:
        self.turns += len(sizes) + 1
        for i, size in enumerate(sizes):
            self.sizes[ids[WIDTH * i : WIDTH * (i + 1)]] = size
        start = above, high.to_bytes(8, "big", signed=True) + low.to_bytes(8, "big", signed=True)
        found = self.trees.get(start)
        if found is None:
            found = self.trees[start] = Tree()
        return found

    def rows(self) -> Iterator[tuple]:
        """Rows of `_NODE`: kind 0 is a node, kind 1 a conversation that ends at one."""
        for (above, start), tree in self.trees.items():
            # Keys of the ways that are open now: nodes come children first, so a way is hashed once from its deepest node.
            keys: list[int] = [int.from_bytes(start, "big")]
            way = b""
            nodes = tree.nodes()
            more = None
            while True:
                try:
                    path, node, count, least, tail = nodes.send(more)
                except StopIteration:
                    break
                depth = len(path) // WIDTH
                same = 0
                while same < min(depth, len(keys) - 1) and way[WIDTH * same : WIDTH * (same + 1)] == path[WIDTH * same : WIDTH * (same + 1)]:
                    same += 1
                del keys[same + 1 :]
                for d in range(same, depth):
                    keys.append(keys[-1] ^ _step(above + d + 1, path[WIDTH * d : WIDTH * (d + 1)]))
                way = path
                key = keys[depth].to_bytes(WIDTH, "big")
                more = 0
                if depth:
                    size = self.sizes[path[-WIDTH:]]
                    more = (size if least < above + depth else 0) if self.owned else count * size
                if depth or not above:
                    parent = keys[depth - 1].to_bytes(WIDTH, "big") if depth else None
                    yield 0, key, parent, above + depth, least, count, tail + more
                if node is not None:
                    for mark in node.marks:
                        yield 1, key, None, above + depth, mark, 1, 0


def _grown(owned: bool, held: int):
    """Nodes of the trees that a task's stretches make. `owned`: sums over what conversations own, else over all members."""

    def flush(trees: _Trees) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in trees.rows():
            rows.append(row)
            if len(rows) == 8192:
                yield _node_rows(rows)
                rows = []
        if rows:
            yield _node_rows(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees(owned)
        names = ("above", "high", "low", "ids", "sizes", "conv_id", "tail", "last", *(("owned_from", "leaf") if owned else ()))
        for batch in batches:
            for above, high, low, ids, sizes, conv, tail, last, *own in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                tree = trees.tree(above, high, low, ids, sizes)
                if owned:
                    first, leaf = own
                    tree.add(ids, int(leaf), first, tail)
                else:
                    tree.add(ids, 1, conv, tail, conv if last else None)
                if trees.turns >= held:
                    yield from flush(trees)
                    trees = _Trees(owned)
        yield from flush(trees)

    return work


_NODE_TYPES = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODE_TYPES, strict=True)], names)


def _listed(ends: DataFrame, listed: int) -> DataFrame:
    """Ids of each node's conversations as decimal texts, ascending, in pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        key, ids = None, []
        names = ["key", "part", "seq", "piece"]
        for batch in batches:
            done = []
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if k != key or len(ids) >= listed:
                    if ids:
                        done.append((key, part, seq, ",".join(ids).encode()))
                        seq += 1
                    key, ids = k, []
                ids.append(str(conv))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (key, part, seq, ",".join(ids).encode())], names)

    return ranged(ends.select("key", "conv_id"), "key", "conv_id").mapInArrow(work, "key binary, part long, seq long, piece binary")


def prefix_trie(conversations: DataFrame, turns: int = TURNS, held: int = HELD, listed: int = LISTED) -> DataFrame:
    """The trie of all rebuilt conversations, a row for each node: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`,
    `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`."""
    packed = Stored(_packed(conversations, turns), "turns")
    whole = Stored(_rebuilt(packed.df), "rebuilt")
    packed.drop()
    stretches = Stored(_connected(whole.df), "stretches")
    whole.drop()
    raw = Stored(stretches.df.mapInArrow(_grown(False, held), _NODE), "nodes")
    nodes = Stored(
        raw.df.where("kind = 0").groupBy("key").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.sum("count").alias("n_convs"), F.sum("total").alias("total"),
        ), "trie",
    )
    children = nodes.df.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    owners = nodes.df.join(children, "key", "left").groupBy("conv_id").agg(
        (F.min("depth") - 1).alias("owned_from"), F.max(F.col("n_children").isNull()).alias("leaf")
    )
    owned = _owned(stretches.df, owners).mapInArrow(_grown(True, held), _NODE).where("kind = 0")
    ends = chained_sha256(_listed(raw.df.where("kind = 1"), listed), ["key"], ["part", "seq"], b",", "ends_sha256")
    parts = [
        nodes.df, children,
        owned.groupBy("key").agg(F.sum("count").alias("n_leaves"), F.sum("total").alias("owned")),
        ends,
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    found = union.groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("parent", "depth", "conv_id", "n_convs", "total")],
        *[F.coalesce(F.max(c), zero).alias(c) for c in ("n_children", "n_leaves", "owned")],
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    above = nodes.df.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("owned")).alias("saved_tokens"), "ends_sha256",
    )


def _owned(stretches: DataFrame, owners: DataFrame) -> DataFrame:
    """The stretches of conversations that own nodes, with the bytes behind each stretch that are owned."""
    joined = stretches.join(owners, "conv_id")
    end = F.col("above") + F.size("sizes")
    # The depth up to which a later stretch belongs to others is beyond this one's end only if nothing here is owned.
    alone = joined.where(F.col("owned_from") <= end)
    later = joined.where(F.col("owned_from") > end).drop("tail")
    size = F.aggregate(
        F.slice("sizes", F.greatest(F.lit(1), F.least(F.size("sizes") + 1, (F.col("owned_from") - F.col("above") + 1).cast("int"))), F.size("sizes")),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    total = joined.where("cut_up").groupBy("conv_id").agg(F.sum(size).alias("tail"))
    return alone.unionByName(later.join(total, "conv_id"))
