import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.plans import answer as A


def frames(spark, n_statements=1):
    questions = spark.createDataFrame(
        [(1, "где?", [1.0, 0.0]), (2, "что?", [0.0, 1.0]), (3, "кто?", [0.0, 0.0])],
        "question_id int, question string, embedding array<double>",
    )
    names = [(str(i), f"Признак: p{i}\nОписание: d", [1.0, 0.01 * i]) for i in range(n_statements)]
    names += [("no", "\n\n\nтекст", [1.0, 0.0]), ("other", "Признак: o", [0.0, 1.0])]
    catalog = spark.createDataFrame(names, "_id string, text string, embedding array<double>")
    return questions, catalog


def records(session):
    rows = [("[50.1, 40.2]", "1", "L", 1.5), ("300", "1", "M", 2.5), (None, None, "M", None)]
    return session.createDataFrame(rows, "lon string, lat string, layer_name string, `Rо,%` double")


def answered(spark, n_statements=1, summaries=None):
    questions, catalog = frames(spark, n_statements)
    hits = A.find_hits(questions, catalog, k=n_statements + 1)
    pairs = hits.where("question_id = 1").select("question_id", "feature_id")
    verdicts = pairs.select("*", F.lit(1).alias("attempt"), F.lit("Да").alias("text"), F.lit(None).cast("string").alias("error"))
    wrong = pairs.select("*", F.lit(1).alias("attempt"), F.lit("SELECT nothing FROM df").alias("sql"))
    text = F.concat(F.lit("```sql\nSELECT *, "), F.regexp_replace("feature_id", r"\D", "9"), F.lit(" AS n FROM df\n```"))
    right = pairs.select("*", F.lit(2).alias("attempt"), text.alias("sql"))
    return hits, A.answer_questions(spark, questions, hits, verdicts, wrong.unionByName(right), records, summaries)


def test_answers(spark):
    hits, out = answered(spark)
    assert {r["question_id"] for r in hits.collect()} == {1, 2}
    found = {r["question_id"]: r for r in out.answers.collect()}
    assert [found[i]["status"] for i in (1, 2, 3)] == ["answered", "no_features", "no_hits"]
    assert found[2]["answer"] == fixed.NO_FEATURES_ANSWER and found[3]["answer"] == fixed.NO_HITS_ANSWER
    assert (found[1]["features"], found[1]["results_count"], found[1]["points"]) == (1, 3, 1)
    assert found[1]["answer"].startswith("Найдено 3 записей:\n\nlon | lat | layer_name | Rо,% | n | matched_feature")
    assert "Долгота: 50.1, Широта: 1" in found[1]["answer"]
    point = out.points.collect()
    assert [(p["lon"], p["lat"], p["info"]) for p in point] == [(50.1, 1.0, "layer_name: L, matched_feature: Признак: p0")]


def test_summary_gets_the_points(spark):
    summaries = spark.createDataFrame([(1, " Ответ. ")], "question_id int, text string")
    _, out = answered(spark, summaries=summaries)
    text = out.answers.where("question_id = 1").head()["answer"]
    assert text.startswith("Ответ.\n\n📍 КООРДИНАТЫ НАЙДЕННЫХ ЗАПИСЕЙ:\n• ")


@pytest.mark.parametrize("limit", [2, 32])
def test_many_statements(spark, monkeypatch, limit):
    """Statements beyond one plan run in batches; every accepted feature keeps all of its rows."""
    monkeypatch.setattr(A, "STATEMENTS_PER_PLAN", limit)
    _, out = answered(spark, n_statements=5)
    row = out.answers.where("question_id = 1").head()
    assert (row["features"], row["results_count"], row["points"]) == (5, 15, 5)


def answer_one(spark, statements, rows):
    """One question with one feature and its statements in turn, over a table of numbers and texts."""
    questions = spark.createDataFrame([(1, "q"), (2, "other")], "question_id int, question string")
    hits = spark.createDataFrame([(1, "f", "p", "d", 1), (2, "g", "o", "d", 1)], "question_id int, feature_id string, feature_name string, description string, rank int")
    verdicts = hits.select("question_id", "feature_id", F.lit(1).alias("attempt"), F.lit("да").alias("text"), F.lit(None).cast("string").alias("error"))
    tries = [(1, "f", i, sql) for i, sql in enumerate(statements, 1)] + [(2, "g", 1, "SELECT n AS only FROM df WHERE n = 0")]
    tried = spark.createDataFrame(tries, "question_id int, feature_id string, attempt int, sql string")
    return A.answer_questions(spark, questions, hits, verdicts, tried, lambda s: s.createDataFrame(rows, "n int, s string, lon string, lat string"))


def test_a_statement_that_fails_ends_neither_its_question_nor_the_others(spark):
    rows = [(i, "text", "1", "2") for i in range(3)]
    out = answer_one(spark, ['SELECT * FROM df WHERE "s" > 5', "SELECT 1/0 AS x FROM df", 'SELECT "n" FROM df'], rows)
    found = {r["question_id"]: r["results_count"] for r in out.answers.collect()}
    assert found == {1: 3, 2: 1}
    errors = {r["sql"]: r["error_class"] for r in out.outcomes.where("not ok").collect()}
    assert sorted(errors.values()) == ["CAST_INVALID_INPUT", "DIVIDE_BY_ZERO"]


def test_names_and_order_of_a_statement(spark):
    rows = [(i, f"t{i}", "1", "2") for i in (9, 100, 10)]
    sql = 'SELECT "n" AS rank, "s" AS feature_name, "s" AS "Feature_name", "n" AS position, "n" AS question_id FROM df ORDER BY "n" DESC'
    out = answer_one(spark, [sql], rows)
    text = out.answers.where("question_id = 1").head()["answer"]
    assert "rank | feature_name | Feature_name_2 | position_2 | question_id_2" in text
    assert [line.split(" | ")[0] for line in text.split("\n") if " | t" in line] == ["100", "10", "9"]
    placed = out.results.where("question_id = 1").orderBy("position").select("position", "rank").collect()
    assert list(map(tuple, placed)) == [(1, 100), (2, 10), (3, 9)]


@pytest.mark.parametrize("limit", [1, 32])
def test_types_are_settled_over_all_statements(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "STATEMENTS_PER_PLAN", limit)
    _, out = answered(spark, n_statements=3)
    guard = A.GuardedSql(spark, records)
    statements = A._Statements(spark, guard)
    statements.run(iter([["SELECT 1 AS v"], ["SELECT 1.0D AS v"], ["SELECT 'x' AS V"]]))
    chosen = statements.found()[0].orderBy("sql").select(A.STATEMENT)
    assert sorted(r[0] for r in statements.rows(chosen).collect()) == ["1", "1.0", "x"]


def test_all_coordinate_lines_are_kept(spark):
    rows = [(i, "t", str(i % 90), str(i % 80)) for i in range(120)]
    out = answer_one(spark, ['SELECT * FROM df ORDER BY "n"'], rows)
    lines = out.lines.where("question_id = 1").orderBy("position").collect()
    assert [r["position"] for r in lines] == list(range(1, 121))
    assert lines[99]["line"] == "Запись 100: Долгота: 9, Широта: 19"
    text = out.answers.where("question_id = 1").head()["answer"]
    assert text.count("Долгота") == 50 and "Показаны координаты 50 из 120" in text
    assert out.points.where("question_id = 1").count() == 120


def test_no_valid_statement(spark):
    questions, catalog = frames(spark)
    hits = A.find_hits(questions, catalog)
    verdicts = hits.select("question_id", "feature_id", F.lit(1).alias("attempt"), F.lit("YES").alias("text"),
                           F.lit(None).cast("string").alias("error"))
    statements = verdicts.select("question_id", "feature_id", "attempt", F.lit("DROP VIEW df").alias("sql"))
    out = A.answer_questions(spark, questions, hits, verdicts, statements, records)
    assert out.results is None
    found = {r["question_id"]: r["answer"] for r in out.answers.collect()}
    assert found[1] == fixed.NO_ROWS_ANSWER


def test_question_text(spark):
    questions, _ = frames(spark)
    responses = spark.createDataFrame([(1, " описание "), (2, "  ")], "question_id int, text string")
    found = {r["question_id"]: r["search_text"] for r in A.question_text(questions, responses).collect()}
    assert found == {1: "описание", 2: "что?", 3: "кто?"}
    assert A.question_text(questions).head()["search_text"] == "где?"


def test_a_statement_over_its_time_is_stopped_and_the_others_run_on(spark):
    """The limit cancels the statement's jobs alone; what waits for a text that another pair runs gets its outcome."""
    endless = "SELECT count(*) AS n FROM range(100000000) a JOIN range(100000000) b ON a.id % 7 <> b.id % 5"
    tried = spark.createDataFrame(
        [
            (1, "a", "A", 1, 1, endless), (1, "a", "A", 1, 2, "SELECT 'slow' AS x FROM df"), (1, "b", "B", 2, 1, "SELECT 'quick' AS x FROM df"),
            (2, "a", "A", 1, 1, endless), (2, "b", "B", 2, 1, "SELECT 'quick' AS x FROM df"),
        ],
        "question_id int, feature_id string, feature_name string, rank int, attempt int, sql string",
    )
    rows, pairs, outcomes = A._run_attempts(A.GuardedSql(spark, records), tried, 4, 8)
    found = {r.sql: (r.ok, r.error_class) for r in outcomes.collect()}
    assert found[endless] == (False, "TIMED_OUT") and len(found) == 3 == outcomes.count()
    assert {(r.question_id, r.feature_id) for r in pairs.collect()} == {(1, "a"), (1, "b"), (2, "b")}
    assert sorted(r.x for r in rows.collect()) == ["quick"] * 3 + ["slow"] * 3
    # Nothing of the statement is left running.
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
