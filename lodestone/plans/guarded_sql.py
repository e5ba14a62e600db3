"""Read-only SQL over one table named `df`.

A statement is analysed, never parsed here: Spark resolves it as a subquery in a session of its own,
which refuses commands and direct file reads, and the resolved plan is checked for other relations and
for functions that call Java code. Analysis starts no job, so a statement runs once, when its result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators.combine import unique_names
from lodestone.session import shared_dir

VIEW = "df"
# Session settings of the guard: quoted names as in standard SQL, and no reads of files by path.
GUARD_CONF = {
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Settings that a new session must take over to plan and run like the caller's.
SHARED_CONF = (
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.sql.files.maxPartitionBytes",
)
# Expressions that run code from outside the query, and leaves that hold no stored data.
FOREIGN_CALLS = {
    "CallMethodViaReflection", "Invoke", "StaticInvoke", "ScalaUDF", "PythonUDF", "HiveSimpleUDF", "HiveGenericUDF",
    "HiveGenericUDTF", "PythonUDTF", "UnresolvedPythonUDTF",
}
# They show where the table is stored.
FOREIGN_CALLS |= {"InputFileName", "InputFileBlockStart", "InputFileBlockLength"}
HARMLESS_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}


@dataclass
class Outcome:
    """Result of a statement: a table, or the reason why there is none."""

    ok: bool
    df: DataFrame | None = None
    error_class: str | None = None
    message: str | None = None
    bindings: list[str] = field(default_factory=list)


class Refused(Exception):
    """The statement resolves, but reads or calls something it may not."""


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _class(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(expression) -> None:
    if _class(expression) in FOREIGN_CALLS:
        raise Refused(f"function not allowed: {expression.prettyName()}")
    for child in _items(expression.children()):
        _check_expression(child)


def _check_plan(plan) -> None:
    """Walk the resolved plan; only the registered view may hold data."""
    kind = _class(plan)
    if kind == "View":
        name = plan.desc().identifier()
        if plan.isTempView() and name.database().isEmpty() and name.table() == VIEW:
            return
        raise Refused(f"relation not allowed: {name.unquotedString()}")
    for expression in _items(plan.expressions()):
        _check_expression(expression)
    for subquery in _items(plan.subqueries()):
        _check_plan(subquery)
    children = list(_items(plan.children()))
    if not children and kind not in HARMLESS_LEAVES:
        raise Refused(f"relation not allowed: {kind}")
    for child in children:
        _check_plan(child)


class GuardedSql:
    """Runs statements over one table.

    `source` builds the table in the session it is given, for example
    `lambda session: session.read.parquet(path)`.
    """

    def __init__(self, spark: SparkSession, source: Callable[[SparkSession], DataFrame]):
        self.session = spark.newSession()
        for key in SHARED_CONF:
            value = spark.conf.get(key, None)
            if value is not None:
                self.session.conf.set(key, value)
        for key, value in GUARD_CONF.items():
            self.session.conf.set(key, value)
        source(self.session).createOrReplaceTempView(VIEW)

    @property
    def table(self) -> DataFrame:
        return self.session.table(VIEW)

    def analyse(self, sql: str) -> Outcome:
        """Check a statement without running it."""
        text = sql.strip().rstrip(";").rstrip()
        try:
            # As a subquery, a command or a second statement cannot resolve.
            probe = self.session.sql(f"SELECT * FROM (\n{text}\n) LIMIT 0")
            _check_plan(probe._jdf.queryExecution().analyzed())
            # The bare text keeps the order of its result.
            return Outcome(True, self.session.sql(text))
        except Refused as error:
            return Outcome(False, error_class="NOT_ALLOWED", message=str(error))
        except PySparkException as error:
            return failure(error)

    def run(self, sql: str) -> DataFrame | None:
        """The result as a lazy table, or None if the statement does not resolve."""
        return self.analyse(sql).df

    def materialise(self, sql: str, path: str | None = None, order: str | None = None, taken: Sequence[str] = ()) -> Outcome:
        """Run a statement into a table in the shared folder, so that errors in its data show too.

        Columns of the same name, and of names in `taken`, are numbered. `order` names a column that rises in the order
        of the result.
        """
        outcome = self.analyse(sql)
        if not outcome.ok:
            return outcome
        path = path or shared_dir(self.session, "result")
        rows = outcome.df.toDF(*unique_names(outcome.df.columns, [*taken, *([order] if order else [])]))
        rows = rows.select(*[F.col(f"`{c}`").cast("string" if kind == "void" else kind).alias(c) for c, kind in rows.dtypes])
        if order:
            rows = rows.withColumn(order, F.monotonically_increasing_id())
        try:
            rows.write.mode("errorifexists").parquet(path)
        except PySparkException as error:
            return failure(error)
        return Outcome(True, self.session.read.parquet(path))

    def first_valid(self, statements: list[str]) -> tuple[int | None, list[Outcome]]:
        """Position of the first statement that resolves, and all outcomes up to it."""
        outcomes = []
        for i, sql in enumerate(statements):
            outcomes.append(self.analyse(sql))
            if outcomes[-1].ok:
                return i, outcomes
        return None, outcomes


def failure(error: PySparkException) -> Outcome:
    parameters = error.getMessageParameters() or {}
    proposal = parameters.get("proposal", "")
    names = [p.strip().strip("`") for p in proposal.split("`, `")] if proposal else []
    return Outcome(False, error_class=error.getCondition(), message=str(error), bindings=names)
