"""Progress of requests: latest state, lifecycle, and the ordered feed, in batch and as a stream.

Events have the columns request_id, ts, seq, step, progress, message, details, status, error and result (the JSON of what a
finished request gives). Last write wins by (ts, seq); the first event whose status is `completed` or `error` ends a request.

The states of a stream are a table of changes, a folder for each micro-batch (`sinks.BatchTable`); the last row of a request counts. A
micro-batch is reduced to one row per request and task, or Arrow batch, before the shuffle, so a request with very many events
is no burden for one task. There are three ways of forgetting:

- `start` without `evict_seconds` keeps every request, as a plain aggregation;
- `start` with it drops a request when the watermark has passed its end by that time; until then its end stays known;
- `start_read` drops a request that time after it was first read in its final state, as a client sees it; unread ones stay.

`start_feed` gives the events of each request in order up to its end. This and `start_read` hold what comes until the watermark has
passed it and take it in the order of event time, so what comes late, but not later than `lateness`, is in its place; what Spark
finds later than that is dropped. The end of a request is remembered for `remember_seconds`, so nothing revives it before. A row whose
request is null is a heartbeat: its time moves the watermark on, and nothing else.

Where Python keeps the state, its keys are a fixed number of buckets of requests, by a hash of the id, and the requests of a bucket are one
Arrow table: a call costs much more than a request, so calls must not grow with requests. Checkpoints hold for one number of buckets.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions import fixed
from lodestone.streaming.sinks import BatchTable, keyed_state

EVENT = (
    "request_id string, ts timestamp, seq bigint, step int, progress int, message string, "
    "details map<string,string>, status string, error string, result string"
)
COLUMNS = tuple(field.split()[0] for field in EVENT.split(", "))
RECORD = ", ".join(field for field in EVENT.split(", ") if field.split()[0] not in ("request_id", "ts", "seq"))
_RECORD = tuple(field.split()[0] for field in RECORD.split(", "))
_PARTIAL = "request_id string, record string, ended boolean, at bigint, seq bigint, last_at bigint, max_progress int, events bigint"
_STATE = _PARTIAL.removeprefix("request_id string, ")
TERMINAL = ("completed", "error")


def clamp(progress: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(progress, F.lit(0))))


def step_name(step: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fixed.STEP_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, step.cast("int")), F.lit(fixed.OTHER_STEP))


def band_progress(done: Column, total: Column, band: tuple[int, int]) -> Column:
    """Per cent of step 3 or 4 after `done` of `total` items: start of the band plus its share."""
    start, width = band
    return F.lit(start) + F.floor(done / total * width).cast("int")


def check_progress(done: Column, total: Column) -> Column:
    return band_progress(done, total, fixed.CHECK_BAND)


def sql_progress(done: Column, total: Column) -> Column:
    return band_progress(done, total, fixed.SQL_BAND)


def _order() -> Column:
    return F.struct("ts", "seq")


def _record() -> Column:
    return F.struct(*[c for c in COLUMNS if c != "request_id"])


def _priority(status: Column, ts: Column, seq: Column) -> Column:
    """Order that puts the event a client sees first: the first terminal one, else the last one."""
    ended = F.coalesce(status.isin(*TERMINAL), F.lit(False))
    at = F.unix_micros(ts)
    return F.struct(
        (~ended).alias("open"), F.when(ended, at).otherwise(-at).alias("at"), F.when(ended, seq).otherwise(-seq).alias("seq")
    )


def reduce_events(events: DataFrame) -> DataFrame:
    """One mergeable row per request: the event to show, the time of the last one, the greatest progress."""
    return events.groupBy("request_id").agg(
        F.min_by(_record(), _priority(F.col("status"), F.col("ts"), F.col("seq"))).alias("event"),
        F.max("ts").alias("last_ts"),
        F.max(clamp(F.col("progress"))).alias("max_progress"),
        F.count(F.lit(1)).alias("events"),
    )


def show_states(states: DataFrame) -> DataFrame:
    """The record a client sees for each request."""
    now = F.col("event")
    done, failed = F.equal_null(now["status"], F.lit("completed")), F.equal_null(now["status"], F.lit("error"))
    return states.select(
        "request_id",
        now["ts"].alias("ts"),
        F.when(done, fixed.DONE_STEP).when(failed, 0).otherwise(F.coalesce(now["step"], F.lit(0))).alias("step"),
        F.when(done, 100).when(failed, 0).otherwise(clamp(now["progress"])).alias("progress"),
        F.when(done, F.lit(fixed.DONE_MESSAGE))
        .when(failed, F.concat(F.lit("Ошибка: "), F.coalesce(now["error"], F.lit(""))))
        .otherwise(F.coalesce(now["message"], F.lit(fixed.FIRST_MESSAGE)))
        .alias("message"),
        now["details"].alias("details"),
        F.when(done | failed, now["status"]).otherwise("processing").alias("status"),
        F.when(failed, now["error"]).alias("error"),
        F.when(done, now["result"]).alias("result"),
        "max_progress",
        "events",
    ).withColumn("step_name", step_name(F.col("step")))


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest state of every request."""
    return show_states(reduce_events(events))


def evict(states: DataFrame, now: Column, seconds: int = fixed.EVICT_SECONDS) -> DataFrame:
    """Drop requests whose terminal state is older than `seconds`."""
    gone = F.col("event.status").isin(*TERMINAL) & (
        F.col("event.ts") + F.make_dt_interval(secs=F.lit(seconds)) < now
    )
    return states.where(~F.coalesce(gone, F.lit(False)))


def event_feed(events: DataFrame) -> DataFrame:
    """Events of each request up to its terminal one, which is marked as final.

    The join's other side has one row per request, so Spark may split a request with very many events over tasks.
    """
    ends = events.where(F.col("status").isin(*TERMINAL)).groupBy("request_id").agg(F.min(_order()).alias("_end"))
    feed = events.join(ends, "request_id", "left").where(F.col("_end").isNull() | (_order() <= F.col("_end")))
    return feed.withColumn("final", F.coalesce(_order() == F.col("_end"), F.lit(False))).drop("_end")


def _json(column: Callable[[str], Column] = F.col) -> Column:
    return F.to_json(F.struct(*[column(c).alias(c) for c in _RECORD]))


def _plain(events: DataFrame) -> DataFrame:
    """Events as keys, numbers and a record."""
    ended = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    return events.select(
        "request_id", F.lit(EVENT_KIND).alias("kind"), F.unix_micros("ts").alias("at"), "seq", clamp(F.col("progress")).alias("progress"),
        ended.alias("ended"), _json().alias("record"),
    )


def _reduced(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per request: the event to show by the rule of `_priority`, and the sums."""
    sign = rows["ended"].map({True: 1, False: -1})
    order = pd.DataFrame({"open": ~rows["ended"], "at": rows["at"] * sign, "seq": rows["seq"] * sign})
    first = rows.loc[order.sort_values(["open", "at", "seq"], kind="stable").index].drop_duplicates("request_id")
    sums = rows.groupby("request_id").agg(last_at=("last_at", "max"), max_progress=("max_progress", "max"), events=("events", "sum"))
    return first[["request_id", "record", "ended", "at", "seq"]].merge(sums, left_on="request_id", right_index=True)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            yield _reduced(rows)


_FIELDS = [field.split()[0] for field in _STATE.split(", ")]


def _first(row: tuple) -> tuple:
    """The order of `_priority` over a partial row."""
    _, ended, at, seq, *_ = row
    return (not ended, at, seq) if ended else (not ended, -at, -seq)


def _merged(a: tuple, b: tuple) -> tuple:
    shown = min(a, b, key=_first)
    return (*shown[:4], max(a[4], b[4]), max(a[5], b[5]), a[6] + b[6])


_CHANGE = f"request_id string, gone boolean, {_STATE}"
_GONE = [None] * len(_FIELDS)

BUCKETS = 1024
#: State of a bucket: an Arrow table.
_ROWS = "rows binary"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _bucket(buckets: int) -> Column:
    """Where the state of a request is kept; heartbeats have no bucket."""
    return F.when(F.col("request_id").isNotNull(), F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int"))


def _packed(rows: list[tuple], names: str) -> bytes:
    schema = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in names.split(", ")])
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    table = pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema, strict=True)], schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns), strict=True))


def _values(rows: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    """Rows as tuples; whole numbers that pandas made fractions because of nulls are whole again, and nulls are nan."""
    columns = [[v if v != v else int(v) for v in rows[c].tolist()] if rows[c].dtype.kind == "f" else rows[c].tolist() for c in names]
    return zip(*columns, strict=True)


_KEPT = f"{_PARTIAL}, leaves bigint"
_UNKNOWN = float("nan")


def _updater(evict_seconds: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _unpacked(state.get[0]) if state.exists else []
        held = {request: tuple(_UNKNOWN if v is None else v for v in row) for request, *row, _ in kept}
        leaves = {request: at for request, *_, at in kept if at is not None}
        now, touched = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for rows in batches:
                # A few rows of a request: one for each Arrow batch that held it.
                for request, *row in _values(rows, ["request_id", *_FIELDS]):
                    held[request] = _merged(held[request], tuple(row)) if request in held else tuple(row)
                    touched.add(request)
        for request in touched:
            _, ended, at, *_ = held[request]
            if ended and at == at:
                leaves[request] = max(at // 1000 + 1000 * evict_seconds, now + 1)
        gone = [request for request, at in leaves.items() if at < now and request not in touched]
        for request in gone:
            del held[request], leaves[request]
        if held:
            state.update((_packed([(request, *row, leaves.get(request)) for request, row in held.items()], _KEPT),))
            if leaves:
                state.setTimeoutTimestamp(max(min(leaves.values()), now + 1))
        else:
            state.remove()
        rows = [(request, True, *_GONE) for request in gone] + [(request, False, *held[request]) for request in touched]
        if rows:
            yield _changes(rows)

    return update


def _changes(rows: list[tuple], names: str = _CHANGE) -> pd.DataFrame:
    # Whole numbers that may be null stay whole.
    return pd.DataFrame(rows, columns=[f.split()[0] for f in names.split(", ")], dtype=object)


_HELD = "kind int, at bigint, seq bigint, progress int, ended boolean, record string"
_HELD_NAMES = [f.split()[0] for f in _HELD.split(", ")]
_HELD_ROWS = f"request_id string, {_HELD}"
_FEED = "request_id string, at bigint, seq bigint, final boolean, record string"
EVENT_KIND, READ_KIND = 0, 1


class _InOrder(StatefulProcessor):
    """Holds the rows of a bucket until the watermark has passed them, then gives those of each request to `take` in the order of event time."""

    def __init__(self, remember_seconds: int):
        self.remember = 1000 * remember_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _ROWS)
        #: Requests that have ended for good, and when that is forgotten, in milliseconds.
        self.closed = handle.getValueState("closed", _ROWS)
        self.alarm = handle.getValueState("alarm", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, closed = None, None
        for some in rows:
            # Heartbeats are not held.
            some = some[some["request_id"].notna()]
            closed = _table(self.closed) if closed is None else closed
            new = [row for row in _values(some, ["request_id", *_HELD_NAMES]) if row[0] not in closed]
            if new:
                # A batch of rows is added at a time; what is held already is not read for it.
                self.held.appendValue((_packed(new, _HELD_ROWS),))
                first = min((row[2] for row in new if row[2] == row[2] and (first is None or row[2] < first)), default=first)
        if first is not None:
            self._wake(first // 1000 + 1, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def _wake(self, at: int, now: int) -> None:
        """One timer a bucket, the earliest that it needs."""
        at, before = max(at, now + 1), self.alarm.get()[0] if self.alarm.exists() else None
        if before is not None and before <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        closed = {request: until for request, (until,) in _table(self.closed).items() if until > now}
        rows = [row for part in self.held.get() for row in _unpacked(part[0])] if self.held.exists() else []
        due = sorted((r for r in rows if r[2] is not None and r[2] < 1000 * now), key=lambda r: (r[0], r[2], r[1], _UNKNOWN if r[3] is None else r[3]))
        by_request = {request: [r[1:] for r in some] for request, some in itertools.groupby(due, key=lambda r: r[0])}
        out, wakes = self.take_all(by_request, closed, now)
        rest = [r for r in rows if r[0] not in closed and (r[2] is None or r[2] >= 1000 * now)]
        if rest:
            self.held.put([(_packed(rest, _HELD_ROWS),)])
        elif rows:
            self.held.clear()
        _keep(self.closed, [(request, until) for request, until in closed.items()], "request_id string, until bigint")
        wakes += [r[2] // 1000 + 1 for r in rest if r[2] is not None]
        wakes += closed.values()
        if wakes:
            self._wake(min(wakes), now)
        if out:
            yield _changes(out, self.names)

    names: str

    def take_all(self, due: dict[str, list[tuple]], closed: dict[str, int], now: int) -> tuple[list[tuple], list[int]]:
        """What the due rows of the bucket's requests give, and when the bucket is wanted again; requests that end for good are added to `closed`."""
        raise NotImplementedError

    def until(self, at: int, now: int) -> int:
        """When it is forgotten that a request ended at `at` (milliseconds)."""
        return max(at + self.remember, now + 1)

    def close(self) -> None:
        pass


def _table(state) -> dict[str, tuple]:
    return {request: tuple(row) for request, *row in _unpacked(state.get()[0])} if state.exists() else {}


def _keep(state, rows: list[tuple], names: str) -> None:
    if rows:
        state.update((_packed(rows, names),))
    elif state.exists():
        state.clear()


class _Feed(_InOrder):
    names = _FEED

    def take_all(self, due, closed, now):
        out = []
        for request, rows in due.items():
            if request in closed:
                continue
            end = next((i for i, row in enumerate(rows) if row[4]), None)
            if end is not None:
                closed[request] = self.until(rows[end][1] // 1000, now)
                rows = rows[: end + 1]
            out += [(request, at, seq, i == end, record) for i, (_, at, seq, _, _, record) in enumerate(rows)]
        return out, []


class _UntilRead(_InOrder):
    """The states of requests, each until `seconds` after the first read that finds it ended."""

    names = _CHANGE

    def __init__(self, seconds: int, remember_seconds: int):
        super().__init__(remember_seconds)
        self.seconds = 1000 * seconds

    def init(self, handle):
        super().init(handle)
        self.shown = handle.getValueState("shown", _ROWS)

    def take_all(self, due, closed, now):
        shown = _table(self.shown)
        out, left = [], [request for request, (*_, leaves) in shown.items() if leaves is not None and request not in due]
        for request in itertools.chain(due, left):
            if request in closed:
                continue
            *state, leaves = shown.get(request, (None,))
            state = tuple(_UNKNOWN if v is None else v for v in state) or None
            changed = False
            for kind, at, seq, progress, ended, record in due.get(request, ()):
                if leaves is not None and at > 1000 * leaves:
                    break
                if kind == EVENT_KIND:
                    row = (record, ended, at, _UNKNOWN if seq is None else seq, at, progress, 1)
                    state, changed = (row if state is None else _merged(state, row)), True
                elif state is not None and state[1] and leaves is None:
                    leaves = at // 1000 + self.seconds
            if leaves is not None and now > leaves:
                shown.pop(request, None)
                closed[request] = self.until(leaves, now)
                out.append((request, True, *_GONE))
                continue
            if state is not None:
                shown[request] = (*state, leaves)
            if changed:
                out.append((request, False, *state))
        _keep(self.shown, [(request, *row) for request, row in shown.items()], _KEPT)
        return out, [row[-1] + 1 for row in shown.values() if row[-1] is not None]


class ProgressStream:
    """Keeps the state of requests from a stream of events below `folder`, and optionally their feed.

    `evict_seconds=None` keeps ended requests for ever. Events may come `lateness` late. `buckets` is for how many requests there are at once.
    """

    def __init__(
        self, spark: SparkSession, folder: str, evict_seconds: int | None = fixed.EVICT_SECONDS, lateness: str = "10 seconds",
        remember_seconds: int = 86_400, buckets: int = BUCKETS,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.evict_seconds, self.lateness, self.remember_seconds, self.buckets = evict_seconds, lateness, remember_seconds, buckets
        self.states, self.events = BatchTable(spark, f"{self.folder}/state"), BatchTable(spark, f"{self.folder}/feed")

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        """The query that keeps the states.

        Without eviction that is the aggregation of `reduce_events`, as in batch; leaving the store takes timers.
        """
        if self.evict_seconds is None:
            reduced = reduce_events(events)
            at = F.unix_micros("event.ts")
            ended = F.coalesce(F.col("event.status").isin(*TERMINAL), F.lit(False))
            states = reduced.select(
                "request_id", F.lit(False).alias("gone"), _json(lambda c: F.col(f"event.{c}")).alias("record"), ended.alias("ended"),
                at.alias("at"), F.col("event.seq").alias("seq"), F.unix_micros("last_ts").alias("last_at"), "max_progress", "events",
            )
            return self._write(states, "update", self.states.write, "states", trigger)
        rows = _plain(events).select(
            "request_id", "record", "ended", "at", "seq", F.col("at").alias("last_at"), F.col("progress").alias("max_progress"),
            F.lit(1).cast("bigint").alias("events"),
        ).mapInPandas(_partial, _PARTIAL)
        rows = rows.withColumn("_ts", F.timestamp_micros("last_at")).withWatermark("_ts", self.lateness)
        states = rows.withColumn("bucket", _bucket(self.buckets)).groupBy("bucket").applyInPandasWithState(
            _updater(self.evict_seconds), _CHANGE, _ROWS, "update", GroupStateTimeout.EventTimeTimeout
        )
        return self._write(states, "update", self.states.write, "states", trigger)

    def start_read(self, events: DataFrame, reads: DataFrame, **trigger) -> StreamingQuery:
        """The query that keeps the states until `evict_seconds` after a client first read them (`reads`: request_id, ts) in the end."""
        polls = reads.select(
            "request_id", F.lit(READ_KIND).alias("kind"), F.unix_micros("ts").alias("at"), F.lit(0).cast("bigint").alias("seq"),
            F.lit(0).alias("progress"), F.lit(False).alias("ended"), F.lit("").alias("record"),
        )
        both = self._in_time(_plain(events).unionByName(polls))
        processor = _UntilRead(self.evict_seconds, self.remember_seconds)
        with keyed_state(self.spark):
            states = both.withColumn("bucket", _bucket(self.buckets)).groupBy("bucket").transformWithStateInPandas(processor, _CHANGE, "Update", "EventTime")
            return self._write(states, "update", self.states.write, "reads", trigger)

    def start_feed(self, events: DataFrame, **trigger) -> StreamingQuery:
        """The query that appends each request's events, in order, to the feed's table."""
        rows = self._in_time(_plain(events))
        with keyed_state(self.spark):
            fed = rows.withColumn("bucket", _bucket(self.buckets)).groupBy("bucket").transformWithStateInPandas(_Feed(self.remember_seconds), _FEED, "Append", "EventTime")
            return self._write(fed, "append", self.events.write, "feed", trigger)

    def _in_time(self, rows: DataFrame) -> DataFrame:
        # Heartbeats have to get as far as the operator: a filter would be pushed below the watermark.
        return rows.withColumn("_ts", F.timestamp_micros("at")).withWatermark("_ts", self.lateness)

    def _write(self, rows: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], name: str, trigger: dict) -> StreamingQuery:
        writer = rows.writeStream.outputMode(mode).foreachBatch(sink)
        writer = writer.option("checkpointLocation", f"{self.folder}/{name}-progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def state(self) -> DataFrame:
        """Latest state of every request that has not been evicted."""
        held = self.states.latest(_CHANGE, "request_id", "events").where("not gone")
        event = F.from_json("record", RECORD)
        event = F.struct(F.timestamp_micros("at").alias("ts"), "seq", *[event[c].alias(c) for c in _RECORD])
        return show_states(held.select("request_id", event.alias("event"), "max_progress", "events"))

    def feed(self) -> DataFrame:
        """Events of each request up to its end."""
        rows = self.events.read(_FEED)
        event = F.from_json("record", RECORD)
        return rows.select("request_id", F.timestamp_micros("at").alias("ts"), "seq", *[event[c].alias(c) for c in _RECORD], "final")
