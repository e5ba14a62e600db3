"""Attempt logs and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions import fixed
from lodestone.operators.answers import data_block, fallback_answer, first_rows, points_section, shown_lines, with_points
from lodestone.operators.attempts import attempt_state, next_step, resolve_verdicts, retry_delay
from lodestone.operators.points import point_lines
from lodestone.operators.position import with_row_position
from lodestone.operators.usage import in_period, price_table, report_lines, usage_events, usage_report
from lodestone.queries.points import records
from lodestone.queries.registry import Tables, query
from lodestone.streaming.metering import usage_by_period


def _tries(t: Tables) -> DataFrame:
    """All events of each user and day as attempts of one statement.

    The type of the event says how the attempt went.
    """
    log = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    in_turn = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    tries = log.withColumn("_rank", F.row_number().over(in_turn))
    kind = F.col("event_type")
    return tries.select(
        "user_id",
        "day",
        F.col("_rank").alias("attempt"),
        F.concat(F.lit("SELECT "), F.col("event_id").cast("string")).alias("sql"),
        (kind == "purchase").alias("ok"),
        F.when(kind == "error", "Read TIMEOUT").when(kind == "view", "handshake lost").when(kind != "purchase", "401")
        .alias("error"),
        F.when(kind == "error", F.array(F.lit("b"), kind)).when(kind == "view", F.array(kind)).alias("bindings"),
    )


TRIES_SQL = """
    tries AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type,
        row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS attempt,
        CASE event_type WHEN 'error' THEN 'Read TIMEOUT' WHEN 'view' THEN 'handshake lost' WHEN 'purchase' THEN NULL
            ELSE '401' END AS error FROM events)"""


@query(f"""
    WITH {TRIES_SQL},
    w AS (SELECT user_id, day, min(attempt) FILTER (event_type = 'purchase') AS won,
        arg_min(event_id, attempt) FILTER (event_type = 'purchase') AS id FROM tries WHERE attempt <= 3 GROUP BY ALL),
    f AS (SELECT t.user_id, t.day, t.attempt, t.error, CASE event_type WHEN 'error' THEN ['b', 'error']
            WHEN 'view' THEN ['view'] ELSE [] END AS names
        FROM tries t JOIN w USING (user_id, day) WHERE t.attempt <= 3 AND event_type <> 'purchase'
        AND (won IS NULL OR t.attempt < won)),
    h AS (SELECT user_id, day, count(*) AS failures, arg_max(error, attempt) AS last_error,
        string_agg('Попытка ' || attempt || ': ' || error || CASE WHEN len(names) > 0 THEN chr(10)
            || 'Доступные колонки: ' || array_to_string(names, ', ') ELSE '' END, chr(10) ORDER BY attempt) AS history,
        list_sort(list_distinct(flatten(list(names)))) AS names FROM f GROUP BY ALL)
    SELECT w.user_id, w.day, CASE WHEN won IS NOT NULL THEN 'accepted' WHEN failures >= 3 THEN 'rejected' ELSE 'retry' END
            AS status,
        won AS accepted_attempt, 'SELECT ' || id AS sql, coalesce(failures, 0) AS failures,
        CASE WHEN won IS NULL AND coalesce(failures, 0) < 3 THEN least(coalesce(failures, 0) + 1, 3) END AS next_template,
        last_error, coalesce(history, '{fixed.NO_HISTORY}') AS error_history,
        coalesce(array_to_string(names, '|'), '') AS bindings
    FROM w LEFT JOIN h USING (user_id, day)""")
def attempt_history(t: Tables) -> DataFrame:
    """What has been tried per key, and which template comes next."""
    state = attempt_state(_tries(t), ["user_id", "day"])
    whole = {c: F.col(c).cast("bigint") for c in ("accepted_attempt", "failures", "next_template")}
    return state.withColumns(whole | {"bindings": F.array_join("bindings", "|")})


@query(f"""
    WITH {TRIES_SQL}
    SELECT user_id, day, attempt, CASE WHEN error IS NULL THEN 'accept'
            WHEN error <> '401' AND attempt < 3 THEN 'retry' ELSE 'reject' END AS step,
        CASE WHEN error <> '401' AND attempt < 3 THEN (2 * 2 ** (attempt - 1))::BIGINT END AS delay FROM tries""")
def retry_decisions(t: Tables) -> DataFrame:
    """What to do after each attempt, and how long to wait."""
    error, attempt = F.col("error"), F.col("attempt")
    return _tries(t).select(
        "user_id",
        "day",
        attempt.cast("bigint").alias("attempt"),
        next_step(error, attempt).alias("step"),
        retry_delay(error, attempt).alias("delay"),
    )


@query(f"""
    WITH {TRIES_SQL},
    s AS (SELECT *, CASE WHEN error IS NOT NULL AND error <> '401' AND attempt < 3 THEN NULL
        ELSE error IS NULL AND contains(event_id::VARCHAR, '7') END AS yes FROM tries WHERE attempt <= 3)
    SELECT user_id, day, coalesce(arg_min(yes, attempt) FILTER (yes IS NOT NULL), false) AS accepted
    FROM s GROUP BY ALL""")
def verdict_resolution(t: Tables) -> DataFrame:
    """Verdict per key from its first final attempt."""
    responses = _tries(t).withColumn("text", F.col("sql"))
    return resolve_verdicts(responses, ["user_id", "day"], words=("7",))


def usage(t: Tables) -> DataFrame:
    """Conversations as responses: the role picks the model, text lengths are tokens.

    A user turn has no total, as in a response that gives only its parts.
    """
    role, size = F.col("role"), F.length("text").cast("bigint")
    model = F.when(role == "user", "GigaChat:light").when(role == "assistant", "GigaChat-Max").otherwise("other")
    return t.conversations.select(
        model.alias("model"),
        size.alias("prompt_tokens"),
        F.col("turn").cast("bigint").alias("completion_tokens"),
        F.when(role == "user", F.lit(0)).otherwise(size + F.col("turn")).cast("bigint").alias("total_tokens"),
    )


USAGE_SQL = """
    u AS (SELECT CASE role WHEN 'user' THEN 'GigaChat:light' WHEN 'assistant' THEN 'GigaChat-Max' ELSE 'other' END AS model,
        length(text) AS p, turn AS c, length(text) + turn AS total FROM conversations WHERE length(text) + turn > 0),
    m AS (SELECT model, CASE model WHEN 'GigaChat:light' THEN 0.2 WHEN 'GigaChat-Max' THEN 1.95 ELSE 1.5 END::DOUBLE AS price,
        count(*) AS requests, sum(p)::BIGINT AS p, sum(c)::BIGINT AS c, sum(total)::BIGINT AS total FROM u GROUP BY 1),
    k AS (SELECT *, total / 1000 * price AS cost FROM m),
    r AS (SELECT *, false AS is_total FROM k UNION ALL
        SELECT NULL, NULL, sum(requests)::BIGINT, sum(p)::BIGINT, sum(c)::BIGINT, sum(total)::BIGINT, sum(cost), true FROM k)"""


@query(f"""
    WITH {USAGE_SQL}
    SELECT model, price AS price_per_1k, requests, p AS prompt_tokens, c AS completion_tokens, total AS total_tokens,
        round(cost, 6) AS cost, round(total / requests, 6) AS avg_tokens, round(p / requests, 6) AS avg_prompt,
        round(c / requests, 6) AS avg_completion, round(cost / requests, 6) AS avg_cost, is_total FROM r""")
def usage_rollup(t: Tables) -> DataFrame:
    """Tokens and cost per model, and in total."""
    report = usage_report(usage_events(usage(t)), price_table(t.spark))
    rounded = ("cost", "avg_tokens", "avg_prompt", "avg_completion", "avg_cost")
    return report.withColumns({c: F.round(c, 6) for c in rounded})


@query(f"""
    WITH {USAGE_SQL}, b AS (SELECT *, replace(format('{{:,}}', total), ',', ' ') AS t,
        replace(format('{{:,}}', p), ',', ' ') AS tp, replace(format('{{:,}}', c), ',', ' ') AS tc FROM r)
    SELECT model, is_total, CASE WHEN is_total THEN repeat('=', 53) || chr(10) || '📊 ОБЩАЯ СТАТИСТИКА' || chr(10)
            || repeat('=', 53) || chr(10) || 'Всего запросов: ' || requests || chr(10) || 'Всего токенов: ' || t || chr(10)
            || printf('💰 Общая стоимость всех тестов: %.4f ₽', cost) || chr(10) || repeat('=', 53)
        ELSE '🤖 Модель: ' || model || chr(10) || printf('   Цена за 1K токенов: %.2f ₽', price) || chr(10)
            || '   Количество запросов: ' || requests || chr(10) || '   Всего токенов: ' || t || chr(10)
            || '     - Входных (prompt): ' || tp || chr(10) || '     - Выходных (completion): ' || tc || chr(10)
            || printf('   Среднее токенов на запрос: %.1f', total / requests) || chr(10)
            || printf('     - Входных: %.1f', p / requests) || chr(10)
            || printf('     - Выходных: %.1f', c / requests) || chr(10)
            || printf('   💰 Общая стоимость: %.4f ₽', cost) || chr(10)
            || printf('   💰 Средняя стоимость запроса: %.4f ₽', cost / requests) END AS block FROM b""")
def usage_text(t: Tables) -> DataFrame:
    """The usage report as text."""
    return report_lines(usage_report(usage_events(usage(t)), price_table(t.spark)))


def metered(events: DataFrame) -> DataFrame:
    """Events as usage: the type is the model, the value is the number of tokens."""
    tokens = F.floor("value").cast("bigint")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        tokens.alias("prompt_tokens"),
        (F.col("user_id") % 3).cast("bigint").alias("completion_tokens"),
        F.lit(None).cast("bigint").alias("total_tokens"),
    )


METERED_SQL = """
    u AS (SELECT ts, event_type AS model, floor(value)::BIGINT AS p, user_id % 3 AS c FROM events
          WHERE greatest(floor(value), user_id % 3) > 0)"""


@query(f"""
    WITH {METERED_SQL}
    SELECT date_trunc('hour', ts) AS period_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS period_end, model,
        count(*) AS requests, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens,
        sum(p + c)::BIGINT AS total_tokens
    FROM u WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2, 3""")
def usage_periods(t: Tables) -> DataFrame:
    """Usage per model and hour of a period."""
    period = in_period(metered(t.events), "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    hours = usage_by_period(period)
    return hours.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})


@query(f"""
    WITH n AS (SELECT lang, source, doc_id, n_chars, count(*) OVER (PARTITION BY lang) AS total,
        row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
    SELECT lang, total AS results_count,
        CASE WHEN total > {fixed.BLOCK_ROWS} THEN 'Найдено ' || total || ' записей. Показаны первые {fixed.BLOCK_ROWS}:'
            || chr(10) || chr(10) ELSE '' END || 'doc_id | source | n_chars' || chr(10)
            || string_agg(concat_ws(' | ', doc_id, source, n_chars), chr(10) ORDER BY rank) AS retrieved_data
    FROM n WHERE rank <= {fixed.BLOCK_ROWS} GROUP BY lang, total""")
def retrieved_block(t: Tables) -> DataFrame:
    """First rows per key as text, with the true row count."""
    order = [F.col("n_chars").desc_nulls_last(), F.col("doc_id").asc()]
    return data_block(t.documents, ["lang"], ["doc_id", "source", "n_chars"], order)


RULE = "=" * fixed.RULE_WIDTH


@query(f"""
    WITH c AS (SELECT c_nationkey AS nation, c_custkey AS key, c_acctbal, n_name,
        count(*) OVER (PARTITION BY c_nationkey) AS total,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank,
        c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') AS good
        FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT *, CASE WHEN good THEN c_acctbal || ', Широта: ' || nation * 4 ELSE nation * 4 || ',5, Широта: '
        || c_acctbal || ',5' END AS place FROM c WHERE rank <= {fixed.BLOCK_ROWS}),
    s AS (SELECT *, CASE WHEN total > {fixed.BLOCK_ROWS} THEN chr(10) || '{fixed.LINES_SHOWN[0]}{fixed.BLOCK_ROWS}{fixed.LINES_SHOWN[1]}'
        || total ELSE '' END AS note FROM p),
    b AS (SELECT nation, n_name, total, CASE WHEN total > {fixed.BLOCK_ROWS} THEN 'Найдено ' || total
            || ' записей. Показаны первые {fixed.BLOCK_ROWS}:' || chr(10) || chr(10) ELSE '' END || 'key | c_acctbal' || chr(10)
            || string_agg(key || ' | ' || c_acctbal, chr(10) ORDER BY rank) AS block,
        string_agg('Запись ' || rank || ': Долгота: ' || place, chr(10) ORDER BY rank) || note AS lines,
        string_agg('• ' || rank || ': Долгота: ' || place, chr(10) ORDER BY rank) || note AS bullets
        FROM s GROUP BY nation, n_name, total, note)
    SELECT nation, 'Найдено ' || total || ' записей:' || chr(10) || chr(10) || block || chr(10) || chr(10) || '{RULE}'
            || chr(10) || '{fixed.POINTS_TITLE}' || chr(10) || '{RULE}' || chr(10) || lines || chr(10) || '{RULE}' AS fallback,
        CASE WHEN contains(n_name, '1') THEN n_name || ' Координаты' ELSE n_name || chr(10) || chr(10)
            || '📍 {fixed.POINTS_TITLE}' || chr(10) || bullets END AS answer FROM b""")
def answer_blocks(t: Tables) -> DataFrame:
    """Answers per nation: the fallback from the rows, and a model's text with its points."""
    named = t.nation.select(F.col("n_nationkey").alias("nation"), "n_name")
    rows = records(t.customer)
    order = [F.col("c_acctbal").desc_nulls_last(), F.col("key").asc()]
    block = data_block(rows, ["nation"], ["key", "c_acctbal"], order)
    # Positions within a nation, over all of its rows.
    ordered = with_row_position(rows.withColumn("_low", -F.col("c_acctbal")), ["nation", "_low", "key"], "_place")
    first = ordered.groupBy("nation").agg(F.min("_place").alias("_first"))
    placed = ordered.join(first, "nation").withColumn("_position", F.col("_place") - F.col("_first") + 1)
    lines = shown_lines(point_lines(placed, "_position", ["nation"]), ["nation"])
    text = F.when(F.col("n_name").contains("1"), F.concat("n_name", F.lit(" Координаты"))).otherwise(F.col("n_name"))
    answers = block.join(lines, "nation").join(named, "nation")
    section = points_section(F.col("lines"), F.col("lines_total"))
    return answers.select(
        "nation",
        fallback_answer(F.col("results_count"), F.col("retrieved_data"), section).alias("fallback"),
        with_points(text, F.col("lines"), F.col("lines_total")).alias("answer"),
    )
