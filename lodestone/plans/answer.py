"""From a table of questions to results, points and answers.

Models stay outside: `find_hits` gives the pairs of question and feature that they are asked about, and their
verdicts, SQL texts and summaries come back as tables keyed by question and feature. Everything else is one
plan over all questions. Each distinct SQL text that is needed runs once, into a table of its own, however many questions share
it, and several run at a time, each with a time limit; a text that fails, in analysis, at run time or by its limit, is an outcome of
that attempt alone, and the next attempt is tried.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from dataclasses import dataclass
from itertools import batched, count

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.functions import fixed
from lodestone.functions.text import feature_description, feature_name, strip, strip_code_fence
from lodestone.operators.answers import data_block, fallback_answer, points_section, shown_lines, with_points
from lodestone.operators.attempts import resolve_verdicts
from lodestone.operators.combine import Columns
from lodestone.operators.knn import knn_topk
from lodestone.operators.points import extract_points, point_lines
from lodestone.operators.position import with_row_position
from lodestone.plans.concurrent import TimedOut, run_all, within
from lodestone.plans.guarded_sql import GuardedSql, Outcome
from lodestone.session import discard, expire, kept, shared_dir

PAIR = ["question_id", "feature_id"]
STATEMENT = "statement_id"
ORDER = "row_order"
# Names of the result's own columns; columns of statements that are called so are numbered.
OWN = ["question_id", "matched_feature", "feature_rank", "position", STATEMENT, ORDER]
# Statements whose rows are aligned in one plan. Types are settled over all of them before, so the number changes no result.
STATEMENTS_PER_PLAN = 32
CHOICE = f"ladder array<string>, {STATEMENT} long"
OUTCOME = f"sql string, {STATEMENT} long, ok boolean, error_class string, message string"


@dataclass
class Answers:
    """Tables of an answered set of questions."""

    features: DataFrame
    results: DataFrame | None
    points: DataFrame | None
    lines: DataFrame | None  # question_id, position, line: all coordinate lines
    outcomes: DataFrame  # every statement that was tried, and its error
    answers: DataFrame


def question_text(questions: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Text to search for: the description of a question, else the question itself."""
    if responses is None:
        return questions.withColumn("search_text", F.col("question"))
    described = responses.select("question_id", F.nullif(strip("text"), F.lit("")).alias("_text"))
    return (
        questions.join(described, "question_id", "left")
        .withColumn("search_text", F.coalesce("_text", "question"))
        .drop("_text")
    )


def find_hits(
    questions: DataFrame, catalog: DataFrame, k: int = fixed.TOP_K, metric: str = "cosine", strip_prefix: bool = False
) -> DataFrame:
    """The k nearest catalog entries of each question, with name and description, stored once.

    questions: question_id, embedding. catalog: _id, text, embedding and optional name fields.
    """
    found = knn_topk(questions, catalog, k, metric, "question_id", "embedding", "_id", "embedding")
    extra = {c: F.col(c) for c in ("feature_name", "name", "description") if c in catalog.columns}
    named = catalog.select(
        "_id",
        feature_name("text", extra.get("feature_name"), extra.get("name"), strip_prefix).alias("feature_name"),
        feature_description("text", extra.get("description")).alias("description"),
    )
    return kept(found.join(named, "_id").withColumnRenamed("_id", "feature_id"), "hits")


def accept_features(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hits with a name and a positive verdict."""
    resolved = resolve_verdicts(verdicts, PAIR).where("accepted").select(*PAIR)
    return hits.where(F.coalesce("feature_name", F.lit("")) != "").join(resolved, PAIR, "left_semi")


class _Statements:
    """Statements that were run into tables `root`/number, `parallel` at a time and each for `seconds` at most."""

    def __init__(self, spark: SparkSession, guard: GuardedSql, parallel: int = fixed.PARALLEL_STATEMENTS, seconds: float | None = None):
        self.spark, self.guard, self.parallel, self.seconds = spark, guard, parallel, seconds
        self.root, self.outcomes, self.choices = (shared_dir(spark, name) for name in ("statements", "outcomes", "choices"))
        self.numbers, self.lock = count(), threading.Lock()
        # What became of a text, by its digest: a statement that several ladders need is run by the first and awaited by the others.
        self.known: dict[bytes, Future] = {}
        self.tried: list[tuple] = []
        self.schemas: dict[int, StructType] = {}
        # The last rows of both tables, at most as many as are run between two writes.
        self.rest: tuple[list[tuple], list[tuple]] = [], []
        self.written = False

    def path(self, number: int) -> str:
        return f"{self.root}/{number}"

    def _once(self, sql: str) -> int | None:
        """Number of the table of a text, or None if it failed."""
        digest = hashlib.sha256(sql.encode()).digest()
        with self.lock:
            known = self.known.get(digest)
            if known is None:
                mine = self.known[digest] = Future()
        if known is not None:
            return known.result()
        number = next(self.numbers)
        try:
            outcome = within(self.spark, self.seconds, lambda: self.guard.materialise(sql, self.path(number), ORDER, OWN))
        except TimedOut as error:
            outcome = Outcome(False, error_class="TIMED_OUT", message=str(error))
        except BaseException as error:
            mine.set_exception(error)
            raise
        if outcome.ok:
            self.schemas[number] = outcome.df.drop(ORDER).schema
        with self.lock:
            self.tried.append((sql, number, outcome.ok, outcome.error_class, outcome.message))
        mine.set_result(number if outcome.ok else None)
        return mine.result()

    def _climb(self, ladder: list[str]) -> tuple[list[str], int | None]:
        """The first text of a ladder that works."""
        return ladder, next((n for n in map(self._once, ladder) if n is not None), None)

    def run(self, ladders: Iterator[list[str]]) -> None:
        """The texts come to the driver ladder by ladder, since each needs a plan of its own; what became of them goes to tables."""
        for some in batched(run_all(self.spark, self._climb, ladders, self.parallel), 256):
            if self.rest[0] or self.rest[1]:
                for rows, kind, path in self._tables():
                    self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
                self.written = True
            with self.lock:
                tried, self.tried = self.tried, []
            self.rest = tried, [row for row in some if row[1] is not None]

    def _tables(self) -> list[tuple[list[tuple], str, str]]:
        return [(self.rest[0], OUTCOME, self.outcomes), (self.rest[1], CHOICE, self.choices)]

    def found(self) -> list[DataFrame]:
        """All outcomes, and the statement that each ladder came to."""
        tables = []
        for rows, kind, path in self._tables():
            table = self.spark.createDataFrame(rows, kind)
            tables.append(table.unionByName(self.spark.read.schema(kind).parquet(path)) if self.written else table)
        return tables

    def rows(self, chosen: DataFrame) -> DataFrame | None:
        """Rows of the chosen statements (their numbers, in the order of their texts) under one set of columns."""
        numbers = [r[STATEMENT] for r in chosen.toLocalIterator()]
        columns = Columns(self.spark)
        for number in numbers:
            columns.add(self.schemas[number])
        unions = []
        for some in batched(numbers, STATEMENTS_PER_PLAN):
            parts = []
            for number in some:
                stored = StructType([*self.schemas[number], StructField(ORDER, LongType())])
                df = self.spark.read.schema(stored).parquet(self.path(number))
                parts.append(df.select(*columns.aligned(df), ORDER, F.lit(number).cast("long").alias(STATEMENT)))
            union = parts[0]
            for part in parts[1:]:
                union = union.unionAll(part)
            unions.append(union)
        expire(self.spark, self.root)
        if len(unions) < 2:
            return unions[0] if unions else None
        target = shared_dir(self.spark, "statement-rows")
        for union in unions:
            union.write.mode("append").parquet(target)
        discard(self.spark, self.root)
        return self.spark.read.parquet(target)


def _run_attempts(
    guard: GuardedSql, tried: DataFrame, parallel: int, seconds: float | None
) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Rows of the statements that answer a pair, the pairs with their statement, and all outcomes.

    The texts of a pair, in order, are its ladder. Each different ladder is climbed until a text works; each text runs once.
    """
    spark = tried.sparkSession
    statements = _Statements(spark, guard, parallel, seconds)
    in_turn = Window.partitionBy(*PAIR).orderBy("attempt", "sql")
    turns = tried.withColumn("_turn", F.row_number().over(in_turn)).where(F.col("_turn") <= fixed.MAX_ATTEMPTS)
    pairs = turns.groupBy(*PAIR).agg(
        F.min("feature_name").alias("feature_name"), F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("_turn", "sql"))).alias("_l")
    )
    pairs = kept(pairs.select(*PAIR, "feature_name", "rank", F.transform("_l", lambda x: x["sql"]).alias("ladder")), "tries")
    statements.run(row["ladder"] for row in pairs.select("ladder").distinct().toLocalIterator())
    outcomes, choices = statements.found()
    chosen = choices.select(STATEMENT).distinct().join(outcomes, STATEMENT).orderBy("sql").select(STATEMENT)
    return statements.rows(chosen), pairs.join(choices, "ladder").drop("ladder"), outcomes


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their position in the question: by the rank of the feature, then in the order of the statement's result."""
    whole = kept(with_row_position(rows, ["question_id", "feature_rank", ORDER], "_place"), "results")
    first = whole.groupBy("question_id").agg(F.min("_place").alias("_first"))
    return whole.join(first, "question_id").withColumn("position", F.col("_place") - F.col("_first") + 1)


def answer_questions(
    spark: SparkSession,
    questions: DataFrame,
    hits: DataFrame,
    verdicts: DataFrame,
    statements: DataFrame,
    records: Callable[[SparkSession], DataFrame],
    summaries: DataFrame | None = None,
    parallel: int = fixed.PARALLEL_STATEMENTS,
    statement_seconds: float | None = fixed.STATEMENT_SECONDS,
) -> Answers:
    """Answer every question.

    questions: question_id, question. hits: as `find_hits` gives them. verdicts: question_id, feature_id,
    attempt, text, error. statements: question_id, feature_id, attempt, sql. summaries: question_id, text.
    `records` gives the table that the SQL reads as `df`. `parallel` statements run at a time; one that takes longer than
    `statement_seconds` is cancelled (`TIMED_OUT`).
    """
    features = accept_features(hits, verdicts)
    tried = (
        statements.where(F.col("attempt") <= fixed.MAX_ATTEMPTS)
        .join(features.select(*PAIR, "feature_name", "rank"), PAIR)
        .withColumn("sql", strip_code_fence("sql"))
    )
    rows, chosen, outcomes = _run_attempts(GuardedSql(spark, records), tried, parallel, statement_seconds)
    counts = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("_hits"))
    accepted = features.groupBy("question_id").agg(F.count(F.lit(1)).alias("features"))
    base = questions.select("question_id", "question").join(counts, "question_id", "left")
    base = base.join(accepted, "question_id", "left")

    results = points = all_lines = None
    if rows is not None:
        data = [c for c in rows.columns if c not in (STATEMENT, ORDER)]
        # Columns of statements may be called like those of the pairs, so they go through the join as one.
        packed = rows.select(STATEMENT, ORDER, F.struct(*[F.col(f"`{c}`") for c in data]).alias("_data"))
        joined = packed.join(chosen, STATEMENT).select(
            "question_id", F.col("feature_name").alias("matched_feature"), F.col("rank").alias("feature_rank"), ORDER, "_data"
        )
        results = _placed(joined).select(
            "question_id", *[F.col("_data").getField(c).alias(c) for c in data], "matched_feature", "feature_rank", "position"
        )
        block = data_block(results, ["question_id"], [*data, "matched_feature"], [F.col("position").asc()])
        base = base.join(block, "question_id", "left")
        points = extract_points(results, keep=["question_id"])
        if "question_id" in points.columns:
            # The text shows the first lines and how many there are; `lines` holds all of them, as `points` does.
            all_lines = point_lines(results, "position", ["question_id"])
            found = points.groupBy("question_id").agg(F.count(F.lit(1)).alias("points"))
            base = base.join(found, "question_id", "left").join(shown_lines(all_lines, ["question_id"]), "question_id", "left")
    for name, kind in (
        ("results_count", "bigint"), ("retrieved_data", "string"), ("points", "bigint"), ("lines", "array<string>"),
        ("lines_total", "bigint"),
    ):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    if summaries is None:
        base = base.withColumn("_summary", F.lit(None).cast("string"))
    else:
        base = base.join(summaries.select("question_id", strip("text").alias("_summary")), "question_id", "left")

    zero = F.lit(0).cast("long")
    lines, total = F.coalesce("lines", F.array().cast("array<string>")), F.coalesce("lines_total", zero)
    block = F.coalesce("retrieved_data", F.lit(fixed.NO_ROWS_BLOCK))
    status = (
        F.when(F.col("_hits").isNull(), "no_hits").when(F.col("features").isNull(), "no_features").otherwise("answered")
    )
    answer = (
        F.when(status == "no_hits", F.lit(fixed.NO_HITS_ANSWER))
        .when(status == "no_features", F.lit(fixed.NO_FEATURES_ANSWER))
        .when(F.col("_summary").isNotNull(), with_points(F.col("_summary"), lines, total))
        .otherwise(fallback_answer(F.col("results_count"), block, points_section(lines, total)))
    )
    answers = base.select(
        "question_id",
        "question",
        status.alias("status"),
        F.coalesce("features", zero).alias("features"),
        F.coalesce("results_count", zero).alias("results_count"),
        F.coalesce("points", zero).alias("points"),
        (F.coalesce("points", zero) > 0).alias("has_coordinates"),
        answer.alias("answer"),
    )
    return Answers(features, results, points, all_lines, outcomes, answers)
