"""Rows in a total order over many tasks, and digests of what stands in such an order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranged(df: DataFrame, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Sorted by `keys`, then `within`, nulls first: each partition holds a range of `keys`, in the order of their numbers."""
    columns = [F.col(k).asc_nulls_first() for k in keys]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns, *within)


def chained_sha256(pieces: DataFrame, keys: list[str], order: list[str], between: bytes = b"", name: str = "sha256") -> DataFrame:
    """`keys` and the SHA-256 (lowercase hex) of the `piece`s of each key, in order, joined by `between`.

    A digest has to read its bytes in order, so all pieces of a key stream through one task, of which it holds one batch; give large
    pieces, put together before, so that these are few rows.
    """
    kinds = pieces.schema
    schema = pa.schema([(k, _arrow(kinds[k].dataType)) for k in keys] + [(name, pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, piece in zip(*columns, batch.column("piece").to_pylist(), strict=True):
                if key != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(piece)
                else:
                    digest.update(between)
                    digest.update(piece)
            if done:
                yield _table(done, schema)
        if digest is not None:
            yield _table([(*current, digest.hexdigest())], schema)

    ready = pieces.select(*keys, *order, "piece").repartition(*keys).sortWithinPartitions(*keys, *order)
    declared = ", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in keys)
    return ready.mapInArrow(work, f"{declared}, {name} string")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
