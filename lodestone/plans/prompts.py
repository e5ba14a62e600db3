"""Prompt tables for outside models: one row per prompt, keyed like the responses that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import fixed, templates as P
from lodestone.functions.templates import fill
from lodestone.functions.text import cut_at_sentence, drop_coordinate_lines, drop_fence_lines, ensure_mention, has_data
from lodestone.operators.attempts import attempt_state, bindings_text

PAIR = ["question_id", "feature_id"]


def question_prompts(questions: DataFrame, template: str = P.DESCRIBE_QUESTION) -> DataFrame:
    """Asks for a description of what each question looks for."""
    return questions.select("question_id", fill(template, {"user_query": "question"}).alias("prompt"))


def match_prompts(hits: DataFrame, questions: DataFrame, template: str = P.MATCH_FEATURE) -> DataFrame:
    """Asks whether a found feature fits its question; a hit without a name is not asked about."""
    asked = hits.where(F.coalesce("feature_name", F.lit("")) != "").join(
        questions.select("question_id", "question"), "question_id"
    )
    places = {"user_query": "question", "feature_name": "feature_name", "feature_description": "description"}
    return asked.select(*PAIR, fill(template, places).alias("prompt"))


def sql_prompts(
    features: DataFrame,
    questions: DataFrame,
    columns_info: DataFrame,
    log: DataFrame | None = None,
    templates: dict[int, str] = P.SQL_TEMPLATES,
    max_attempts: int = fixed.MAX_ATTEMPTS,
) -> DataFrame:
    """Asks for SQL for each accepted feature, with the template that its attempts so far call for.

    `columns_info` is the one-row text of the column profile. `log` holds the attempts (question_id,
    feature_id, attempt, sql, ok, error, bindings). Pairs that are accepted or rejected get no prompt.
    """
    pairs = features.join(questions.select("question_id", "question"), "question_id")
    if log is None:
        states = pairs.select(*PAIR, F.lit(1).alias("next_template"))
        for name in ("last_error", "error_history", "last_sql"):
            states = states.withColumn(name, F.lit(None).cast("string"))
        states = states.withColumn("bindings", F.array().cast("array<string>"))
    else:
        last = log.where(F.col("attempt") <= max_attempts).groupBy(*PAIR).agg(F.max_by("sql", "attempt").alias("last_sql"))
        states = attempt_state(log, PAIR, max_attempts).join(last, PAIR)
        states = pairs.select(*PAIR).join(states, PAIR, "left").where(F.coalesce("status", F.lit("retry")) == "retry")
        states = states.withColumn("next_template", F.coalesce("next_template", F.lit(1)))
    ready = pairs.join(states, PAIR).withColumn("columns_info", columns_info.scalar())
    names = F.coalesce("bindings", F.array().cast("array<string>"))
    places = {
        "user_query": "question",
        "feature_name": "feature_name",
        "feature_description": "description",
        "columns_info": "columns_info",
        "sql_query": "last_sql",
        "error_message": F.coalesce("last_error", F.lit(fixed.UNKNOWN_ERROR)),
        "error_history": F.coalesce("error_history", F.lit(fixed.NO_HISTORY)),
        "candidate_bindings": bindings_text(names),
    }
    prompt = F.lit(None).cast("string")
    for number, template in templates.items():
        prompt = F.when(F.col("next_template") == number, fill(template, places)).otherwise(prompt)
    return ready.select(*PAIR, F.col("next_template").alias("attempt"), prompt.alias("prompt"))


def summary_prompts(
    questions: DataFrame, blocks: DataFrame, sections: DataFrame | None = None, template: str = P.SUMMARISE
) -> DataFrame:
    """Asks for an answer from the retrieved rows; a question without rows says that there are none."""
    ready = questions.select("question_id", "question").join(blocks, "question_id", "left")
    section = F.lit("")
    if sections is not None:
        ready = ready.join(sections, "question_id", "left")
        section = F.coalesce("coordinates_section", F.lit(""))
    places = {
        "user_query": "question",
        "retrieved_data": F.coalesce("retrieved_data", F.lit(fixed.NO_ROWS_BLOCK)),
        "coordinates_section": section,
    }
    return ready.select("question_id", fill(template, places).alias("prompt"))


def speech_prompts(answers: DataFrame, template: str = P.SPEECH) -> DataFrame:
    """Asks for a short text to read aloud, for answers that hold data."""
    note = F.when(F.col("has_coordinates"), F.lit("Скажи, что координаты видны на карте.")).otherwise("")
    places = {"user_query": "question", "full_answer": "answer", "map_note": note}
    return answers.where(has_data("answer")).select("question_id", fill(template, places).alias("prompt"))


def speech_text(answer: Column, has_points: Column, response: Column) -> Column:
    """Text to read aloud, or null for an answer without data.

    The response without its fences, else the answer without its coordinate lines; then the map sentence and
    the cut at a sentence end.
    """
    text = F.coalesce(drop_fence_lines(response), drop_coordinate_lines(answer))
    return F.when(has_data(answer), cut_at_sentence(ensure_mention(text, F.coalesce(has_points, F.lit(False)))))
