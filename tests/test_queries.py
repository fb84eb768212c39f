"""Every registered query against its SQL over the smallest tables, hashes of floats aside by rounding."""

import os

import duckdb
import numpy as np
import pytest

from millrace.queries import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return c


def plain(df):
    def cell(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return ""
        return repr(round(float(v), 9)) if isinstance(v, (float, np.floating)) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, db):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
