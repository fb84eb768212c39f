"""Collects the query callables and their SQL from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from millrace.plans.session import spread

TEXTS = {"documents"}  # tables whose queries are bound by what they do with a row
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (t, spark) -> DataFrame under its name; t(name) reads a table. sql is the same result in DuckDB."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir):
            def table(name):
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return spread(df) if name in TEXTS else df

            return f(table, spark)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    from millrace.queries import agents, relational, surfaces, texts, vectors  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
