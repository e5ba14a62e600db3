import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from lodestone.session import build_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return TESTDATA


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of an expression over rows of text cells, in order."""

    def run(expression, cells, kind="string"):
        rows = spark.createDataFrame(list(enumerate(cells)), f"i int, c {kind}")
        return [row["out"] for row in rows.select("i", expression.alias("out")).orderBy("i").collect()]

    return run
