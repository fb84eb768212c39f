"""Operators that SQL can express, against their SQL over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf):
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    got, want = queries.queries()[name](spark, sf).toPandas(), db.execute(queries.oracle_sql()[name]).df()

    def plain(df):
        return sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns) and len(got) and plain(got) == plain(want)
