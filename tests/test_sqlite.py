"""SQLite as a data source: round trips, pushed filters, ranges of rowids, tasks that fail."""

import datetime as dt
import os
import re
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.sources import sqlite as S

SCHEMA = "id long, name string, price decimal(12,2), x double, day date, at timestamp, ok boolean, raw binary, `odd \"name` int"


def some(spark):
    rows = [(i, None if i % 11 == 0 else f"n{i % 7}é", Decimal(i) / 4, float("nan") if i % 13 == 0 else i / 3 - 5, dt.date(2024, 1, 1) + dt.timedelta(i), dt.datetime(2024, 1, 1, 0, 0, i % 60, 250), None if i % 5 == 0 else i % 2 == 0, bytes([i % 256, 0]), i) for i in range(500)]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_round_trip(spark, tmp_path):
    df = some(spark)
    S.write_sqlite(df.repartition(3), f"file://{tmp_path}/t", "t")
    got = S.read_sqlite(spark, f"file://{tmp_path}/t", "t", df.schema, rows=100)
    assert same(got, df) and got.rdd.getNumPartitions() >= 5
    S.write_sqlite(df.limit(3), f"{tmp_path}/t", "t")
    assert S.read_sqlite(spark, f"{tmp_path}/t", "t", df.schema).count() == 503
    S.write_sqlite(df.limit(3), f"{tmp_path}/t", "t", mode="overwrite")
    assert S.read_sqlite(spark, f"{tmp_path}/t", "t").count() == 3  # schema by the file
    S.write_sqlite(df.limit(0), f"{tmp_path}/t", "t", mode="overwrite")
    assert S.read_sqlite(spark, f"{tmp_path}/t", "t", df.schema).count() == 0 and not os.listdir(f"{tmp_path}/t")


@pytest.mark.parametrize(
    "where",
    [
        "id >= 100 AND id < 250", "id = 7", "id <=> 7", "name = 'n3é'", "name > 'n3'", "name IS NULL", "name IS NOT NULL AND NOT (name = 'n1é')", "name IN ('n1é', 'n2é', 'x')", "name LIKE 'n1%'", "name LIKE '%é'", "name LIKE '%2%'",
        "price > 10.5", "price = 3.25", "x > 20", "x = double('NaN')", "x < 0", "day < '2024-02-01'", "at = timestamp'2024-01-01 00:00:07.000250'", "ok", "NOT ok", "id > 3 OR name = 'n1é'", "`odd \"name` = 5", "raw = x'0500'", "id % 2 = 0 AND id > 400",
    ],
)
def test_filters(spark, tmp_path_factory, where):
    """Each gives the rows that Spark would choose, whoever decides it."""
    at = tmp_path_factory.getbasetemp() / "filters"
    df = some(spark)
    if not at.exists():
        S.write_sqlite(df.repartition(2), str(at), "t")
    assert same(S.read_sqlite(spark, str(at), "t", df.schema, rows=120).where(where), df.where(where))


def test_filters_reach_sqlite(spark, tmp_path):
    df = some(spark)
    S.write_sqlite(df.coalesce(1), f"{tmp_path}/t", "t")
    got = S.read_sqlite(spark, f"{tmp_path}/t", "t", "id long, name string", rows=1000)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan(got.where("id > 490 AND name LIKE 'n%'")))
    assert re.search(r"\bFilter\b", plan(got.where("id % 2 = 0")))
    reader = S.SqliteReader(f"{tmp_path}/t", "t", 100, got.schema)
    left = list(reader.pushFilters([S.GreaterThan(("id",), 490), S.EqualTo(("price",), Decimal(1)), S.StringStartsWith(("name",), "n")]))
    assert [type(f) for f in left] == [S.EqualTo] and len(reader.partitions()) == 5
    sql, marks = reader.statement(reader.partitions()[-1])
    assert sql == 'SELECT "id", "name" FROM "t" WHERE (_rowid_ >= ?) AND (_rowid_ < ?) AND ("id" > ?) AND (substr("name", 1, 1) = ?)' and marks == [401, 501, 490, "n"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == got.where("id > 490 AND name LIKE 'n%'").count() > 0


def test_files_of_others(spark, tmp_path):
    """Gaps in rowids, tables without them, views, a database with more tables."""
    db = sqlite3.connect(f"{tmp_path}/own.sqlite")
    db.execute("CREATE TABLE runs (run_id VARCHAR(32), start_time BIGINT, share REAL)")
    db.executemany("INSERT INTO runs (rowid, run_id, start_time, share) VALUES (?, ?, ?, ?)", [(i * i - 50, f"r{i}", i, i / 2) for i in range(100)])
    db.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    db.execute("INSERT INTO bare VALUES ('a', 1), ('b', 2)")
    db.execute("CREATE VIEW late AS SELECT run_id FROM runs WHERE start_time > 90")
    db.commit()
    db.close()
    runs = S.read_sqlite(spark, f"{tmp_path}/own.sqlite", "runs", rows=1000)
    assert runs.dtypes == [("run_id", "string"), ("start_time", "bigint"), ("share", "double")] and runs.rdd.getNumPartitions() == 10
    assert runs.agg(F.sum("start_time"), F.sum("share")).first()[:] == (4950, 2475.0)
    assert S.read_sqlite(spark, f"{tmp_path}/own.sqlite", "bare").where("v > 1").collect()[0][:] == ("b", 2)
    assert S.read_sqlite(spark, f"{tmp_path}/own.sqlite", "late").count() == 9
    with pytest.raises(Exception, match="no table nope"):
        S.read_sqlite(spark, f"{tmp_path}/own.sqlite", "nope")
    with pytest.raises(Exception, match="mounted folder"):
        S.read_sqlite(spark, "hdfs://a/b", "t")


def test_a_write_that_fails(spark, tmp_path):
    S.write_sqlite(spark.range(10), f"{tmp_path}/t", "t")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            S.write_sqlite(bad, f"{tmp_path}/t", "t", mode)
    assert S.read_sqlite(spark, f"{tmp_path}/t", "t").count() == 10 and not [f for f in os.listdir(f"{tmp_path}/t") if f.startswith("_")]
