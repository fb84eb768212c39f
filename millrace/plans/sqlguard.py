"""The SQL surface for agents: list, describe, sample, and run queries that only read, with a row cap and an approval hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """The statement isn't a query, or it wasn't approved."""


def tables(spark: SparkSession, hidden: tuple[str, ...] = ("sqlite_", "_")) -> list[str]:
    """Names of the tables and views; system names are hidden."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith(hidden))


def describe(spark: SparkSession, names: list[str], rows: int = 3) -> str:
    """Columns and sample rows of each table; an unknown name gives its error text, and stops no other."""
    out = []
    for name in names:
        try:
            df = spark.table(name)
            lines = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
            out.append(f"{name} (" + ", ".join(lines) + ")\n" + "\n".join(str(tuple(r)) for r in df.limit(rows).collect()))
        except PySparkException as e:
            out.append(f"Error: {name}: {e.getCondition() or e}")
    return "\n\n".join(out)


#: Kinds of parsed nodes that change something, and functions that call other code; fixed values.
CHANGES = ("Command", "ParsedStatement")
CALLS = {"reflect", "java_method", "try_reflect"}


def _nodes(plan) -> Iterator:
    """All nodes of a parsed plan, those of common table expressions and subqueries included."""
    yield plan
    for below in (plan.children(), plan.innerChildren()):
        for i in range(below.size()):
            if below.apply(i).getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical"):
                yield from _nodes(below.apply(i))


def _parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def reads_only(spark: SparkSession, sql: str) -> bool:
    """Whether the statement parses to a plan without a command or a write, and calls no code by name. Asked of the nodes'
    classes: what texts and names in the statement say has no part in it."""
    named = spark._jvm.java.lang.Class.forName
    kinds = [named("org.apache.spark.sql.catalyst.plans.logical." + k) for k in CHANGES]
    function = named("org.apache.spark.sql.catalyst.analysis.UnresolvedFunction")
    for node in _nodes(_parsed(spark, sql)):
        if any(k.isInstance(node) for k in kinds):
            return False
        waiting = [node.expressions()]
        while waiting:
            some = waiting.pop()
            for i in range(some.size()):
                e = some.apply(i)
                if function.isInstance(e) and str(e.nameParts().last()).lower() in CALLS:
                    return False
                waiting.append(e.children())
    return True


def has_limit(spark: SparkSession, sql: str) -> bool:
    """Whether the result as a whole has a limit: the plan's top node is one, below common table expressions at most."""
    plan = _parsed(spark, sql)
    while plan.getClass().getSimpleName() == "UnresolvedWith":
        plan = plan.child()
    return plan.getClass().getSimpleName() == "GlobalLimit"


def query(spark: SparkSession, sql: str, most: int = 5, approve: Callable[[str], bool] | None = None, ceiling: int = 1000) -> DataFrame:
    """The query's rows, at most that many; if it has a limit of its own, at most ceiling. Raises Refused or Spark's errors."""
    if not reads_only(spark, sql):
        raise Refused("only queries are run")
    if approve and not approve(sql):
        raise Refused("not approved")
    return spark.sql(sql).limit(ceiling if has_limit(spark, sql) else most)


def answer(spark: SparkSession, sql: str, most: int = 5, approve: Callable[[str], bool] | None = None) -> tuple[DataFrame | None, str | None]:
    """(rows, None) or (None, 'Error: ...'): for callers that pass errors on as text."""
    try:
        return query(spark, sql, most, approve), None
    except Refused as e:
        return None, f"Error: {e}"
    except PySparkException as e:
        return None, f"Error: {e.getCondition() or e}"
