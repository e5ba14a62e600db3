"""Progress and metering, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import fixed
from lodestone.queries.logs import METERED_SQL, metered
from lodestone.queries.registry import Tables, query
from lodestone.session import shared_dir
from lodestone.streaming.distinct import distinct_stream
from lodestone.streaming.metering import meter_stream
from lodestone.streaming.progress import (
    ProgressStream, check_progress, clamp, event_feed, evict, latest_progress, reduce_events, show_states,
    sql_progress, step_name,
)
from lodestone.streaming.sessions import session_stream, sessions


def progress_events(events: DataFrame) -> DataFrame:
    """Events as progress events: a user's day is a request, the type gives step and status."""
    kind = F.col("event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", 1).when(kind == "view", 2).when(kind == "click", 3).otherwise(5).alias("step"),
        F.floor("value").cast("int").alias("progress"),
        kind.alias("message"),
        F.from_json("props", "map<string,string>").alias("details"),
        F.when(kind == "purchase", "completed").when(kind == "error", "error").alias("status"),
        F.when(kind == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error"),
        F.when(kind == "purchase", F.concat(F.lit('{"results_count": '), F.col("event_id").cast("string"), F.lit("}"))).alias("result"),
    )


EVENTS_SQL = """
    p AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS request_id, ts, event_id AS seq,
        CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 5 END AS step,
        least(100, greatest(0, floor(value)))::INTEGER AS progress, event_type AS message,
        CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' END AS status,
        CASE event_type WHEN 'error' THEN 'event ' || event_id END AS error,
        CASE event_type WHEN 'purchase' THEN '{"results_count": ' || event_id || '}' END AS result, json_extract_string(props, '$.k') AS k
        FROM events)"""

LATEST_SQL = f"""
    WITH {EVENTS_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY status IS NULL, CASE WHEN status IS NULL THEN NULL
            ELSE ts END, CASE WHEN status IS NULL THEN NULL ELSE seq END, ts DESC, seq DESC) AS n,
        count(*) OVER (PARTITION BY request_id) AS events, max(progress) OVER (PARTITION BY request_id) AS top FROM p),
    s AS (SELECT *, CASE status WHEN 'completed' THEN 6 WHEN 'error' THEN 0 ELSE step END AS shown FROM n WHERE n = 1)
    SELECT request_id, ts, shown AS step, CASE status WHEN 'completed' THEN 100 WHEN 'error' THEN 0 ELSE progress END
            AS progress,
        CASE status WHEN 'completed' THEN '{fixed.DONE_MESSAGE}' WHEN 'error' THEN 'Ошибка: ' || error ELSE message END
            AS message,
        k, coalesce(status, 'processing') AS status, error, result, top AS max_progress, events,
        CASE shown WHEN 1 THEN 'Генерация описания' WHEN 2 THEN 'Поиск в OpenSearch' WHEN 3 THEN 'Проверка признаков'
            WHEN 5 THEN 'Формирование ответа' WHEN 6 THEN 'Завершено' ELSE 'Обработка...' END AS step_name
    FROM s"""


def _flat(states: DataFrame) -> DataFrame:
    plain = states.withColumn("k", F.try_element_at("details", F.lit("k"))).drop("details")
    return plain.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(LATEST_SQL)
def progress_latest(t: Tables) -> DataFrame:
    """Latest state of every request."""
    return _flat(latest_progress(progress_events(t.events)))


@query(f"""
    SELECT * FROM ({LATEST_SQL}) WHERE status = 'processing'
        OR ts + INTERVAL 30 SECOND >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR""")
def progress_active(t: Tables) -> DataFrame:
    """Requests that are still held, a day and a half before the end of the events: ended ones go after 30 s."""
    events = progress_events(t.events)
    now = events.agg(F.max("ts") - F.make_dt_interval(hours=F.lit(36))).scalar()
    return _flat(show_states(evict(reduce_events(events), now)))


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream; the pattern also matches a folder of files."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.directory}/event[s].parquet")


@query(LATEST_SQL)
def progress_stream(t: Tables) -> DataFrame:
    """The same states from a stream, in Spark's state store."""
    stream = ProgressStream(t.spark, shared_dir(t.spark, "progress"), evict_seconds=None)
    stream.start(progress_events(event_stream(t))).awaitTermination()
    return _flat(stream.state())


@query(f"""
    SELECT * FROM ({LATEST_SQL}) WHERE status = 'processing'
        OR epoch_ms(ts) + 30000 >= (SELECT epoch_ms(max(ts)) FROM events) - 10000""")
def progress_stream_evicted(t: Tables) -> DataFrame:
    """The states that a stream still holds at the end: those that ended have left, half a minute behind the watermark."""
    stream = ProgressStream(t.spark, shared_dir(t.spark, "progress"))
    stream.start(progress_events(event_stream(t))).awaitTermination()
    return _flat(stream.state())


FEED_SQL = f"""
    WITH {EVENTS_SQL},
    f AS (SELECT *, min(CASE WHEN status IS NOT NULL THEN ts END) OVER (PARTITION BY request_id) AS ended FROM p)
    SELECT request_id, ts, seq, step, progress, message, status, error, result, coalesce(ts = ended, false) AS final
    FROM f WHERE ended IS NULL OR ts <= ended"""


def _feed(feed: DataFrame) -> DataFrame:
    return feed.select(
        "request_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "step",
        clamp(F.col("progress")).alias("progress"), "message", "status", "error", "result", "final",
    )


@query(FEED_SQL)
def progress_feed(t: Tables) -> DataFrame:
    """Events of each request until it is done."""
    return _feed(event_feed(progress_events(t.events)))


SLICES = 3


def in_slices(start: Callable[..., StreamingQuery], *tables: DataFrame, jitter: str = "0", copies: int = 1, heartbeat: int | None = None) -> None:
    """Runs a stream over tables with a time `ts`, slice by slice of event time: each start goes on where the last one stopped.

    `jitter`: seconds by which a row is late for its slice. `copies`: how often each row comes, in its slice and the one after it.
    `heartbeat`: a last row of nulls so many seconds after the last time.
    """
    spark = tables[0].sparkSession
    folders = [shared_dir(spark, "slices") for _ in tables]
    spans = [rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first() for rows in tables]
    first, last = min((s[0] or 0 for s in spans)), max((s[1] or 0 for s in spans))
    place = F.floor((F.unix_micros("ts") + F.expr(jitter) * 1_000_000 - first) / ((last - first) // SLICES + 1))
    place = F.least(F.lit(SLICES - 1), place)

    def go(number: int, parts: list[DataFrame]) -> None:
        for folder, part in zip(folders, parts, strict=True):
            part.write.parquet(f"{folder}/{number}")
        start(*[spark.readStream.schema(t.schema).parquet(f"{f}/*") for t, f in zip(tables, folders, strict=True)]).awaitTermination()

    for number in range(SLICES + copies - 1):
        go(number, [rows.where(place.between(number - copies + 1, number)) for rows in tables])
    if heartbeat is not None:
        beat = spark.range(1).select(F.timestamp_micros(F.lit(last + heartbeat * 1_000_000)).alias("ts"))
        go(SLICES + copies, [rows.limit(0).unionByName(beat, allowMissingColumns=True) for rows in tables])


@query(FEED_SQL)
def progress_feed_stream(t: Tables) -> DataFrame:
    """The same feed from a stream of several micro-batches, with events up to five seconds late."""
    stream = ProgressStream(t.spark, shared_dir(t.spark, "feed"))
    in_slices(stream.start_feed, progress_events(t.events), jitter="seq % 6", heartbeat=60)
    return _feed(stream.feed())


@query(f"""
    WITH {EVENTS_SQL},
    e AS (SELECT request_id, min(ts) AS ended FROM p WHERE status IS NOT NULL GROUP BY 1),
    r AS (SELECT request_id, min(ts) AS first_read FROM p JOIN e USING (request_id) WHERE seq % 3 = 0 AND ts >= ended GROUP BY 1),
    l AS ({LATEST_SQL})
    SELECT l.* FROM l LEFT JOIN r USING (request_id)
    WHERE first_read IS NULL OR epoch_ms(first_read) + 30000 >= (SELECT epoch_ms(max(ts)) FROM events) + 50000""")
def progress_stream_read(t: Tables) -> DataFrame:
    """The states that are left when each is dropped half a minute after it was first read in its end; every third event comes with a read."""
    stream = ProgressStream(t.spark, shared_dir(t.spark, "reads"))
    events = progress_events(t.events)
    reads = events.where("seq % 3 = 0").select("request_id", "ts")
    in_slices(stream.start_read, events, reads, heartbeat=60)
    return _flat(stream.state())


def _session_sql(closed: str = "") -> str:
    return f"""
        WITH b AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
        n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM b)
        SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events, round(sum(value), 6) AS total,
            count(*) FILTER (event_type = 'purchase') AS purchases
        FROM n GROUP BY user_id, n {closed}"""


def _measures() -> list[Column]:
    return [F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("purchases")]


def _session_rows(found: DataFrame) -> DataFrame:
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return found.withColumns(times).select("user_id", "session_start", "session_end", "events", "total", "purchases")


def _timed(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query(_session_sql())
def event_sessions(t: Tables) -> DataFrame:
    """Sessions of users: events less than half an hour apart."""
    return _session_rows(sessions(_timed(t), ["user_id"], "30 minutes", _measures()))


@query(_session_sql("HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"))
def event_sessions_stream(t: Tables) -> DataFrame:
    """The same from a stream with late events: the sessions that the watermark has closed."""
    folder = shared_dir(t.spark, "sessions")

    def start(events: DataFrame) -> StreamingQuery:
        return session_stream(events, f"{folder}/rows", f"{folder}/progress", ["user_id"], "30 minutes", _measures())

    in_slices(start, _timed(t), jitter="(event_id % 10) * 55")
    return _session_rows(t.spark.read.parquet(f"{folder}/rows"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def distinct_events_stream(t: Tables) -> DataFrame:
    """Every event once, from a stream that gives each of them twice, in files that overlap in time."""
    folder = shared_dir(t.spark, "distinct")

    def start(events: DataFrame) -> StreamingQuery:
        return distinct_stream(events, f"{folder}/rows", f"{folder}/progress", ["event_id"])

    twice = _timed(t).select("event_id", "ts", "user_id", "event_type", "value")
    in_slices(start, twice, jitter="event_id % 6", copies=2)
    return t.spark.read.parquet(f"{folder}/rows").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    WITH n AS (SELECT event_id, (event_id % 20) + 1 AS done FROM events)
    SELECT event_id, (45 + floor(done / 20 * 15))::INTEGER AS checked, (65 + floor(done / 20 * 20))::INTEGER AS queried,
        CASE done WHEN 1 THEN 'Генерация описания' WHEN 2 THEN 'Поиск в OpenSearch' WHEN 3 THEN 'Проверка признаков'
            WHEN 4 THEN 'SQL запросы' WHEN 5 THEN 'Формирование ответа' WHEN 6 THEN 'Завершено' ELSE 'Обработка...' END
            AS step_name FROM n""")
def progress_bands(t: Tables) -> DataFrame:
    """Per cent within the bands of steps 3 and 4."""
    done, total = F.col("event_id") % 20 + 1, F.lit(20)
    return t.events.select(
        "event_id",
        check_progress(done, total).alias("checked"),
        sql_progress(done, total).alias("queried"),
        step_name(done).alias("step_name"),
    )


@query(f"""
    WITH {METERED_SQL}
    SELECT date_trunc('hour', ts) AS period_start, model, count(*) AS requests, sum(p)::BIGINT AS prompt_tokens,
        sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens
    FROM u WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
    GROUP BY 1, 2""")
def usage_stream(t: Tables) -> DataFrame:
    """Hourly usage from a stream: the hours that the watermark has closed."""
    folder = shared_dir(t.spark, "usage")
    meter_stream(metered(event_stream(t)), f"{folder}/hours", f"{folder}/checkpoint").awaitTermination()
    hours = t.spark.read.parquet(f"{folder}/hours").drop("period_end")
    return hours.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))
