import pytest

from lodestone.plans.guarded_sql import GuardedSql

ROWS = [("L1", "R1", 1.5, 0.4, "[50.1, 40.2]"), ("L1", "R2", None, 0.9, "1"), ("L2", None, 0.7, None, "2")]
SCHEMA = "layer_name string, `Регион` string, `Rо,%` double, `Сорг,%` double, lon string"


@pytest.fixture(scope="module")
def guard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records") / "df")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    spark.range(5).createOrReplaceTempView("other")
    spark.createDataFrame([(1,)], "secret int").createOrReplaceGlobalTempView("shared")
    guard = GuardedSql(spark, lambda session: session.read.parquet(path))
    guard.path = path
    return guard


ACCEPTED = [
    ('SELECT "Rо,%", "lon" FROM df WHERE "Rо,%" > 1.0 AND "Rо,%" IS NOT NULL LIMIT 10', 1),
    ('SELECT MAX("Сорг,%") AS m, "Регион" FROM df WHERE "Сорг,%" IS NOT NULL GROUP BY "Регион" ORDER BY m DESC', 2),
    ("WITH a AS (SELECT * FROM df) SELECT * FROM a ORDER BY layer_name LIMIT 2;", 2),
    ("SELECT * FROM df a WHERE EXISTS (SELECT 1 FROM df b WHERE b.layer_name > a.layer_name)", 2),
    ("SELECT 1 AS one", 1),
    ("SELECT layer_name, row_number() OVER (ORDER BY lon) AS n FROM df", 3),
]


@pytest.mark.parametrize("sql, rows", ACCEPTED)
def test_accepted(guard, sql, rows):
    assert guard.run(sql).count() == rows


REFUSED = [
    "DROP VIEW df",
    "INSERT INTO df SELECT * FROM df",
    "SHOW TABLES",
    "SELECT 1) x; DROP VIEW df --",
    "SELECT * FROM parquet.`{path}`",
    "SELECT * FROM df WHERE lon IN (SELECT lon FROM parquet.`{path}`)",
    "SELECT (SELECT max(lon) FROM parquet.`{path}`) AS m FROM df",
    "WITH x AS (SELECT * FROM parquet.`{path}`) SELECT * FROM x",
    "SELECT * FROM df WHERE EXISTS (SELECT 1 FROM parquet.`{path}`)",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT input_file_name() AS f FROM df",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM df",
    "SELECT (SELECT try_reflect('java.lang.System', 'getenv', 'HOME')) AS v FROM df",
    "SELECT * FROM other",
    "SELECT * FROM global_temp.shared",
    "WITH df AS (SELECT * FROM global_temp.shared) SELECT * FROM df",
    "SELECT * FROM df WHERE EXISTS (SELECT 1 FROM global_temp.shared)",
    "SELECT * FROM df WHERE 1 IN (SELECT secret FROM global_temp.shared)",
    "SELECT (SELECT max(secret) FROM global_temp.shared) AS m FROM df",
    "SELECT * FROM df, LATERAL (SELECT secret FROM global_temp.shared) x",
    "SELECT layer_name FROM df GROUP BY layer_name HAVING max(lon) IN (SELECT 'a' FROM global_temp.shared)",
    "WITH x AS (SELECT 1 AS a) SELECT * FROM x WHERE a IN (WITH y AS (TABLE global_temp.shared) SELECT * FROM y)",
    "SELECT * FROM df ORDER BY (SELECT reflect('java.lang.System', 'getenv', 'HOME'))",
    "SET spark.sql.runSQLOnFiles=true",
    "CREATE TABLE t AS SELECT * FROM df",
    "EXECUTE IMMEDIATE 'SELECT 1'",
    "CACHE TABLE df",
    "",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(guard, sql):
    outcome = guard.analyse(sql.format(path=guard.path))
    assert not outcome.ok and outcome.df is None and outcome.error_class
    assert guard.run(sql.format(path=guard.path)) is None
    assert guard.table.count() == 3


def test_order_of_the_statement_is_kept(guard):
    rows = guard.run('SELECT "Сорг,%" AS c FROM df ORDER BY c DESC NULLS LAST').collect()
    assert [r["c"] for r in rows] == [0.9, 0.4, None]


def test_latin_name_is_another_column(guard):
    outcome = guard.analyse('SELECT "Ro,%" FROM df')
    assert outcome.error_class == "UNRESOLVED_COLUMN.WITH_SUGGESTION"
    assert "Rо,%" in outcome.bindings


def test_incomplete_group_by(guard):
    outcome = guard.analyse('SELECT MAX("Сорг,%") AS m, layer_name FROM df')
    assert outcome.error_class.startswith("MISSING_")


def test_error_in_the_data(guard):
    sql = "SELECT * FROM df WHERE layer_name > 5"
    assert guard.analyse(sql).ok
    assert guard.materialise(sql).error_class == "CAST_INVALID_INPUT"
    assert guard.materialise("SELECT count(*) AS n FROM df").df.head()["n"] == 3


def test_first_valid(guard):
    at, outcomes = guard.first_valid(["SELECT x FROM df", "SELECT lon FROM df", "SELECT 1"])
    assert at == 1 and [o.ok for o in outcomes] == [False, True]
