"""Ordered feeds, reading and forgetting, sessions and distinct events as streams."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_progress import add, events_of, plain, some_events, source, write_batches

from lodestone.session import shared_dir
from lodestone.streaming import progress as P
from lodestone.streaming.distinct import distinct_stream
from lodestone.streaming.sessions import session_stream, sessions

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def beat(spark, folder, second):
    """A heartbeat: it moves the watermark and nothing else."""
    add(spark, folder, f"beat{second}", [(None, second, 0, 0, 0, None)])


def shuffled(rows, by):
    """Rows of which each is at most `by` places late."""
    rng = random.Random(3)
    return sorted(rows, key=lambda r: r[1] + rng.randrange(by))


def test_feed_is_ordered_whole_and_ends(spark):
    """Late events come in their place: batches overlap by some seconds, and every request's rows rise over the batches."""
    rows = some_events()[:240]
    folder = write_batches(spark, shuffled(rows, 8), 3)
    stream = P.ProgressStream(spark, shared_dir(spark, "feed"))
    stream.start_feed(source(spark, folder)).awaitTermination()
    beat(spark, folder, 10_000)
    stream.start_feed(source(spark, folder)).awaitTermination()
    expected = P.event_feed(events_of(spark, rows))
    assert plain(stream.feed().select(*P.COLUMNS, "final")) == plain(expected.select(*P.COLUMNS, "final"))
    places = stream.events.read(P._FEED).groupBy("request_id", "batch").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    last = {}
    for row in places.orderBy("request_id", "batch").collect():
        assert row.low > last.get(row.request_id, -1)
        last[row.request_id] = row.high


def test_a_batch_that_is_run_again_repeats_no_row(spark):
    rows = some_events()[:150]
    folder = write_batches(spark, rows, 3)
    stream = P.ProgressStream(spark, shared_dir(spark, "feed"))
    write, failed = stream.events.write, []

    def breaks_once(found, batch):
        write(found, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("the process ends after the rows were written")

    stream.events.write = breaks_once
    with pytest.raises(Exception, match="ends after the rows"):
        stream.start_feed(source(spark, folder)).awaitTermination()
    beat(spark, folder, 10_000)
    stream.start_feed(source(spark, folder)).awaitTermination()
    assert failed == [1]
    expected = P.event_feed(events_of(spark, rows)).select("request_id", "seq", "final")
    assert plain(stream.feed().select("request_id", "seq", "final")) == plain(expected)


def test_what_is_read_in_its_end_is_forgotten(spark):
    """Unread requests stay, read ones leave half a minute after the first read that found them ended, and nothing revives them."""
    folder, polls = shared_dir(spark, "events"), shared_dir(spark, "reads")
    stream = P.ProgressStream(spark, shared_dir(spark, "progress"), lateness="5 seconds")
    schema = events_of(spark, [("a", 0, 0, 0, 0, None)]).select("request_id", "ts").schema

    def after(name, rows, reads):
        add(spark, folder, name, rows)
        events_of(spark, [(r, s, 0, 0, 0, None) for r, s in reads]).select("request_id", "ts").write.parquet(f"{polls}/{name}")
        found = spark.readStream.schema(schema).parquet(f"{polls}/*")
        stream.start_read(source(spark, folder), found).awaitTermination()
        return {r.request_id: (r.status, r.events) for r in stream.state().collect()}

    first = [("a", 0, 1, 1, 5, None), ("a", 10, 2, 6, 100, "completed"), ("b", 10, 3, 1, 5, "completed"), ("c", 10, 4, 1, 5, None)]
    # A read before the end does not count; that of c finds it open.
    found = after("p0", [*first, (None, 30, 0, 0, 0, None)], [("a", 5), ("c", 12), (None, 30)])
    assert found == {"a": ("completed", 2), "b": ("completed", 1), "c": ("processing", 1)}
    assert after("p1", [(None, 60, 0, 0, 0, None)], [("a", 40), (None, 60)])["a"] == ("completed", 2)
    # 30 s after the read at 40 the watermark has passed; b was never read.
    assert after("p2", [(None, 80, 0, 0, 0, None)], [(None, 80)]) == {"b": ("completed", 1), "c": ("processing", 1)}
    assert "a" not in after("p3", [("a", 78, 9, 1, 5, None), (None, 100, 0, 0, 0, None)], [(None, 100)])


def visits(spark, rows):
    """(user, minute) to events."""
    base = spark.createDataFrame([(u, START + timedelta(minutes=m), i) for i, (u, m) in enumerate(rows)], "u string, ts timestamp, n int")
    return base


def test_sessions_and_a_late_bridge(spark):
    rows = [("a", 0), ("a", 20), ("a", 60), ("b", 5), ("a", 40), (None, 3), ("a", 100), ("b", 35), ("b", 36)]
    found = sessions(visits(spark, rows), ["u"], "30 minutes", [F.sum("n").alias("n")])
    minutes = lambda t: int((t.replace(tzinfo=timezone.utc) - START).total_seconds() // 60)
    assert sorted((r.u, minutes(r.session_start), minutes(r.session_end), r.events) for r in found.collect()) == [
        # An event a whole gap later joins still: sessions that touch are one.
        ("a", 0, 60, 4), ("a", 100, 100, 1), ("b", 5, 36, 3),
    ]


def test_session_stream_merges_what_comes_late(spark):
    folder = shared_dir(spark, "visits")
    batches = [[("a", 0), ("a", 40), ("b", 1)], [("a", 45), ("b", 50)], [("a", 25)], [("z", 400)]]
    schema = visits(spark, [("a", 0)]).schema
    found = []
    for i, rows in enumerate(batches):
        visits(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{i}")
        events = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        session_stream(events, f"{folder}/out", f"{folder}/progress", ["u"], lateness="30 minutes").awaitTermination()
        found.append(sorted((r.u, r.events) for r in spark.read.parquet(f"{folder}/out").collect()))
    # At first there are two sessions of a; the event at 25 makes them one.
    assert found == [[], [], [], [("a", 4), ("b", 1), ("b", 1)]]


def test_copies_are_dropped_and_the_state_shrinks(spark):
    folder = shared_dir(spark, "copies")
    schema = visits(spark, [("a", 0)]).schema
    sizes = []
    for i in range(4):
        rows = [(f"{i}-{n}", 30 * i + n % 5) for n in range(50)]
        part = visits(spark, rows + rows[::-1]).select("u", "ts", "n")
        part.repartition(3).write.parquet(f"{folder}/in/{i}")
        events = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        query = distinct_stream(events, f"{folder}/out", f"{folder}/progress", ["u"])
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == out.select("u").distinct().count() == 200
    # What the watermark has passed has left: the store holds the last slice, not all of them.
    assert max(sizes) <= 100 and sizes[-1] <= 50
