import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators.attempts import attempt_state, next_step, resolve_verdicts, retry_delay
from lodestone.operators.usage import in_period, price_table, report_lines, report_text, usage_events, usage_report
from lodestone.streaming.metering import usage_by_period


def test_retry(spark):
    rows = [(1, "read timeout"), (2, "SSL handshake"), (3, "timeout"), (1, "401"), (1, None)]
    log = spark.createDataFrame(list(enumerate(rows)), "i int, t struct<attempt: int, error: string>").select("i", "t.*")
    error, attempt = F.col("error"), F.col("attempt")
    found = log.select("i", next_step(error, attempt), retry_delay(error, attempt)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [
        ("retry", 2), ("retry", 4), ("reject", None), ("reject", None), ("accept", None),
    ]


def test_generation_is_retried_on_any_error(spark):
    log = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (1, None)], "attempt int, error string")
    error, attempt = F.col("error"), F.col("attempt")
    delay = retry_delay(error, attempt, words=None, first=fixed.FIRST_GENERATION_DELAY)
    found = log.select("attempt", "error", next_step(error, attempt, words=None), delay).collect()
    assert sorted(tuple(r)[2:] for r in found if r["error"]) == [("reject", None), ("retry", 1), ("retry", 2)]


LOG = "key string, attempt int, sql string, ok boolean, error string, bindings array<string>"


def test_attempt_state(spark):
    rows = [
        ("won", 1, "s1", False, "e1", ["b", "a"]), ("won", 2, "s2", True, None, None), ("won", 3, "s3", False, "e3", None),
        ("lost", 1, "s1", False, "e1", ["x"]), ("lost", 2, "s2", False, "e2", ["x", "w"]), ("lost", 3, "s3", False, None, None),
        ("open", 1, "s1", False, "e1", None), ("late", 4, "s4", True, None, None), ("late", 1, "s", False, "e", None),
    ]
    # A third of the log is copies of one attempt.
    state = attempt_state(spark.createDataFrame(rows + [rows[0]] * 500, LOG), ["key"])
    found = {r["key"]: r for r in state.collect()}
    assert (found["won"]["status"], found["won"]["sql"], found["won"]["accepted_attempt"]) == ("accepted", "s2", 2)
    assert found["won"]["error_history"] == "Попытка 1: e1\nДоступные колонки: b, a"
    assert found["won"]["bindings"] == ["a", "b"] and found["won"]["next_template"] is None
    assert (found["lost"]["status"], found["lost"]["failures"], found["lost"]["bindings"]) == ("rejected", 3, ["w", "x"])
    assert found["lost"]["error_history"].endswith(f"Попытка 3: {fixed.UNKNOWN_ERROR}")
    assert (found["open"]["status"], found["open"]["next_template"], found["open"]["last_error"]) == ("retry", 2, "e1")
    assert found["late"]["status"] == "retry"


def test_verdicts(spark):
    rows = [
        ("a", 1, None, "timeout"), ("a", 2, "да", None), ("b", 1, None, "401"), ("b", 2, "да", None),
        ("c", 1, "нет", None), ("d", 1, None, "timeout"), ("e", 1, "нет", None), ("e", 2, "да", None),
    ]
    log = spark.createDataFrame(rows, "key string, attempt int, text string, error string")
    found = {r["key"]: r["accepted"] for r in resolve_verdicts(log, ["key"]).collect()}
    assert found == {"a": True, "b": False, "c": False, "d": False, "e": False}


USAGE = "model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


def test_usage(spark):
    rows = [("GigaChat:light", 0, 0, 0), ("GigaChat:light", 10, 5, None), ("new", 10, 5, 0), ("new", None, None, 7)]
    events = usage_events(spark.createDataFrame(rows, USAGE))
    assert sorted((r["model"], r["total_tokens"]) for r in events.collect()) == [
        ("GigaChat:light", 15), ("new", 7), ("new", 15),
    ]
    report = {r["model"]: r for r in usage_report(events, price_table(spark)).collect()}
    assert report["new"]["price_per_1k"] == 1.5 and report["new"]["avg_tokens"] == 11.0
    assert report[None]["requests"] == 3 and report[None]["is_total"]
    assert report[None]["cost"] == pytest.approx(15 / 1000 * 0.2 + 22 / 1000 * 1.5)


def test_published_usage(spark):
    """57 requests of 57 878 tokens cost 11.5756, 0.2031 each."""
    events = spark.range(57).select(
        F.lit("GigaChat:light").alias("model"),
        F.when(F.col("id") == 0, 54744).otherwise(0).cast("bigint").alias("prompt_tokens"),
        F.when(F.col("id") == 0, 3134).otherwise(0).cast("bigint").alias("completion_tokens"),
        F.when(F.col("id") == 0, 57878).otherwise(0).cast("bigint").alias("total_tokens"),
    )
    blocks = [r["block"] for r in report_lines(usage_report(events, price_table(spark))).collect()]
    for line in (
        "🤖 Модель: GigaChat:light", "   Цена за 1K токенов: 0.20 ₽", "   Количество запросов: 57",
        "   Всего токенов: 57 878", "     - Входных (prompt): 54 744", "     - Выходных (completion): 3 134",
        "   Среднее токенов на запрос: 1015.4", "     - Входных: 960.4", "     - Выходных: 55.0",
        "   💰 Общая стоимость: 11.5756 ₽", "   💰 Средняя стоимость запроса: 0.2031 ₽",
    ):
        assert line in blocks[0].split("\n")
    assert "Всего токенов: 57 878\n💰 Общая стоимость всех тестов: 11.5756 ₽" in blocks[1]
    text = report_text(usage_report(events, price_table(spark)), "2026-01-13 17:42:16").head()["report"]
    assert text.startswith("📈 Статистика использования токенов GigaChat API\nОбновлено: 2026-01-13 17:42:16\n=====")
    assert text.index("GigaChat:light") < text.index("ОБЩАЯ СТАТИСТИКА") and text.endswith("=" * 53 + "\n")
    empty = report_text(usage_report(events.where("false"), price_table(spark)), "now").head()["report"]
    assert empty.endswith("Статистика пока отсутствует.\n")


def test_periods(spark):
    rows = spark.sql(
        "SELECT make_timestamp(2024, 1, 1, id DIV 4, 15 * (id % 4), 0) AS ts, 'm' AS model, 1L AS prompt_tokens, "
        "1L AS completion_tokens, CAST(NULL AS BIGINT) AS total_tokens FROM range(40)"
    )
    held = in_period(rows, "2024-01-01 02:00:00", "2024-01-01 04:30:00")
    hours = usage_by_period(held).orderBy("period_start").collect()
    assert [(r["requests"], r["total_tokens"]) for r in hours] == [(4, 8), (4, 8), (2, 4)]
