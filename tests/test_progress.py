import random

import pytest
from pyspark.sql import functions as F

from lodestone.session import shared_dir
from lodestone.streaming import progress as P
from lodestone.streaming.metering import meter_stream, usage_by_period


def events_of(spark, rows):
    """(request, second, seq, step, progress, status) to events."""
    base = spark.createDataFrame(rows, "request_id string, s int, seq bigint, step int, progress int, status string")
    return base.select(
        "request_id",
        F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"),
        "seq", "step", "progress",
        F.concat(F.lit("m"), "seq").alias("message"),
        F.create_map(F.lit("k"), F.col("seq").cast("string")).alias("details"),
        "status",
        F.when(F.col("status") == "error", "broken").alias("error"),
        F.when(F.col("status") == "completed", F.concat(F.lit("r"), "seq")).alias("result"),
    )


def some_events():
    rng = random.Random(5)
    rows = []
    for i in range(600):
        # One request holds a third of all events.
        request = "hot" if i % 3 == 0 else f"r{rng.randrange(30)}"
        status = rng.choice([None] * 30 + ["completed", "error"])
        rows.append((request, i, i, rng.randrange(1, 6), rng.randrange(-5, 110), status))
    return rows


def plain(df):
    return sorted(map(str, df.collect()))


def test_lifecycle(spark):
    rows = [
        ("a", 1, 1, 1, 20, None), ("a", 2, 2, 3, 50, None), ("a", 2, 1, 2, 40, None),
        ("b", 1, 1, 5, 90, None), ("b", 3, 2, 5, 95, "completed"), ("b", 4, 3, 2, 10, None),
        ("c", 1, 1, 4, 70, "error"), ("d", 1, 1, 2, 150, None),
    ]
    found = {r["request_id"]: r for r in P.latest_progress(events_of(spark, rows)).collect()}
    assert (found["a"]["step"], found["a"]["progress"], found["a"]["status"]) == (3, 50, "processing")
    assert (found["b"]["step"], found["b"]["progress"], found["b"]["status"]) == (6, 100, "completed")
    assert (found["b"]["result"], found["c"]["result"], found["a"]["result"]) == ("r2", None, None)
    assert found["b"]["step_name"] == "Завершено" and found["b"]["message"] == "Запрос выполнен успешно"
    assert (found["c"]["step"], found["c"]["message"], found["c"]["error"]) == (0, "Ошибка: broken", "broken")
    assert found["d"]["progress"] == 100


def test_bands(spark):
    row = spark.range(1).select(
        *[P.check_progress(F.lit(i), F.lit(n)) for i, n in ((1, 20), (20, 20), (1, 3))],
        *[P.sql_progress(F.lit(i), F.lit(n)) for i, n in ((1, 3), (3, 3))],
    )
    assert list(row.head()) == [45 + int(1 / 20 * 15), 60, 50, 71, 85]


def write_batches(spark, rows, parts):
    folder = shared_dir(spark, "events")
    step = -(-len(rows) // parts)
    for i in range(parts):
        events_of(spark, rows[i * step : (i + 1) * step]).coalesce(1).write.parquet(f"{folder}/p{i}")
    return folder


def source(spark, folder):
    schema = events_of(spark, [("a", 0, 0, 0, 0, None)]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_equals_batch(spark):
    rows = some_events()
    folder = write_batches(spark, rows, 4)
    stream = P.ProgressStream(spark, shared_dir(spark, "progress"), evict_seconds=None)
    stream.start(source(spark, folder)).awaitTermination()
    stream.start_feed(source(spark, folder)).awaitTermination()
    # The feed holds what the watermark has not passed, so a heartbeat ends it.
    add(spark, folder, "beat", [(None, 10_000, 0, 0, 0, None)])
    stream.start_feed(source(spark, folder)).awaitTermination()
    events = events_of(spark, rows)
    assert plain(stream.state()) == plain(P.latest_progress(events))
    assert plain(stream.feed().select(*P.COLUMNS, "final")) == plain(P.event_feed(events).select(*P.COLUMNS, "final"))


def add(spark, folder, name, rows):
    events_of(spark, rows).coalesce(1).write.parquet(f"{folder}/{name}")


def test_a_stream_goes_on_where_it_stopped(spark):
    folder = shared_dir(spark, "events")
    stream = P.ProgressStream(spark, shared_dir(spark, "progress"))
    add(spark, folder, "p0", [("a", 0, 1, 1, 5, None), ("b", 0, 2, 1, 5, None)])
    stream.start(source(spark, folder)).awaitTermination()
    add(spark, folder, "p1", [("a", 3, 3, 2, 30, None), ("c", 3, 4, 1, 5, None)])
    stream.start(source(spark, folder)).awaitTermination()
    assert sorted((r.request_id, r.progress, r.events) for r in stream.state().collect()) == [("a", 30, 2), ("b", 5, 1), ("c", 5, 1)]


def test_eviction_and_late_events(spark):
    """An ended request is held for 30 s of event time and leaves then; what comes late for it changes nothing."""
    folder = shared_dir(spark, "events")
    stream = P.ProgressStream(spark, shared_dir(spark, "progress"), lateness="0 seconds")

    def after(name, rows):
        add(spark, folder, name, rows)
        stream.start(source(spark, folder)).awaitTermination()
        return {r.request_id: r.status for r in stream.state().collect()}

    assert after("p0", [("a", 0, 1, 1, 5, "completed"), ("b", 0, 2, 1, 5, None)]) == {"a": "completed", "b": "processing"}
    assert after("p1", [("c", 20, 3, 1, 5, None)])["a"] == "completed"
    # Still held, so an event behind the end does not revive it.
    assert after("p2", [("a", 25, 4, 1, 6, None)])["a"] == "completed"
    assert after("p3", [("c", 60, 5, 1, 6, None)]) == {"b": "processing", "c": "processing"}
    assert after("p4", [("a", 26, 6, 2, 7, None)]) == {"b": "processing", "c": "processing"}


def test_feed_ends_with_one_final_event(spark):
    feed = P.event_feed(events_of(spark, some_events())).groupBy("request_id").agg(
        F.sum(F.col("final").cast("int")).alias("finals"),
        F.max_by("final", F.struct("ts", "seq")).alias("last_is_final"),
        F.count_if(F.col("status").isNotNull()).alias("ended"),
    )
    for row in feed.collect():
        assert row["finals"] == row["ended"] <= 1
        assert row["last_is_final"] == (row["ended"] == 1)


@pytest.mark.parametrize("files", [1, 3])
def test_meter_stream(spark, files):
    rows = spark.sql(
        "SELECT make_timestamp(2024, 1, 1, 0, 0, 0) + make_dt_interval(0, 0, id) AS ts, 'm' || (id % 2) AS model, "
        "id AS prompt_tokens, 1L AS completion_tokens, CAST(NULL AS BIGINT) AS total_tokens FROM range(600)"
    )
    folder = shared_dir(spark, "usage")
    for i in range(files):
        rows.where(f"prompt_tokens DIV {600 // files} = {i}").coalesce(1).write.parquet(f"{folder}/in/p{i}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    meter_stream(source, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    closed = usage_by_period(rows).where("period_end <= timestamp'2024-01-01 09:49:00'")
    assert plain(spark.read.parquet(f"{folder}/out")) == plain(closed)


@pytest.mark.parametrize("kind", ["evicted", "feed", "read"])
def test_calls_and_states_do_not_grow_with_requests(spark, kind):
    """300 requests, a third of them ended, are seven buckets of state, and give what each gives alone."""
    rows = [(f"r{i % 300}", i, i, 1, i % 100, "completed" if i % 900 < 100 and i >= 300 else None) for i in range(900)]
    folder = shared_dir(spark, "events")
    stream = P.ProgressStream(spark, shared_dir(spark, "progress"), buckets=7)

    def after(name, rows):
        add(spark, folder, name, rows)
        if kind == "evicted":
            query = stream.start(source(spark, folder))
        elif kind == "feed":
            query = stream.start_feed(source(spark, folder))
        else:
            query = stream.start_read(source(spark, folder), source(spark, folder).where("seq % 2 = 0").select("request_id", "ts"))
        query.awaitTermination()
        return query

    after("p0", rows[:450])
    query = after("p1", rows[450:])
    last = after("p2", [(None if kind != "evicted" else "beat", 10_000, 901, 1, 0, None)])
    for q in (query, last):
        # A state and a timer, or the three of a processor, for each bucket.
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 6 * 7 for p in q.recentProgress)
    events = events_of(spark, rows)
    if kind == "feed":
        assert plain(stream.feed().select(*P.COLUMNS, "final")) == plain(P.event_feed(events).select(*P.COLUMNS, "final"))
        return
    ended = {}
    for request, at, _, _, _, status in rows:
        if status and request not in ended:
            ended[request] = at
    if kind == "read":
        ended = {r for r, end in ended.items() if any(q == r and s >= end and s % 2 == 0 for q, s, *_ in rows)}
    left = P.latest_progress(events).where(~F.col("request_id").isin(list(ended)))
    assert plain(stream.state().where("request_id <> 'beat'")) == plain(left)
