"""Sources, the SQL surface, workflows and streams."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.plans import sqlguard, workflow
from millrace.sources import files, store
from millrace.streaming import heartbeats as H


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, 'he said "x"\nand, left'), (1, "plain")], "id int, q string")
    files.write_csv(df, f"{tmp_path}/a", index=F.col("id"))
    got = files.csv(spark, f"{tmp_path}/a", "n int, id int, q string", ["id", "q"])
    assert sorted(map(tuple, got.collect())) == [(1, "plain"), (2, 'he said "x"\nand, left')]
    many = spark.range(500).select((999 - F.col("id")).alias("k"), (F.col("id") % 7).alias("_at")).repartition(5)
    files.write_csv(many, f"{tmp_path}/many", index=F.col("k").desc())
    numbered = files.csv(spark, f"{tmp_path}/many", "n long, k long, a long").collect()
    assert sorted(map(tuple, numbered)) == [(i, 999 - i, i % 7) for i in range(500)]
    files.write_json(df, f"{tmp_path}/j")
    assert spark.read.schema("id int, q string").json(f"{tmp_path}/j").count() == 2
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/x.txt").write_text("Ann: hi")
    (tmp_path / "d/y.pdf").write_bytes(b"%PDF")
    (tmp_path / "list.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    assert files.json_documents(spark, f"{tmp_path}/list.json", "id string").count() == 2
    assert files.text_documents(spark, f"{tmp_path}/d/e").first().text == "Ann: hi"
    pdf = files.folder(spark, f"{tmp_path}/d", (".pdf", "txt"))
    out = {r.path[-5:]: (r.text, r.error) for r in files.converted(pdf, lambda b: b.decode().split(":")[1]).collect()}
    assert out["x.txt"] == (" hi", None) and out["y.pdf"][1].startswith("IndexError")
    files.write_batches(df, f"{tmp_path}/b", 1)
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    assert spark.range(1).select(files.stamped("run", "csv", now)).first()[0] == "run_20240506_070809.csv"


def test_keyed_table(spark, tmp_path):
    t = store.KeyedTable(spark, f"{tmp_path}/t", "k string, v int, seq int", "k", "seq").create()
    assert t.snapshot().count() == 0
    t.put(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], t.schema))
    t.put(spark.createDataFrame([("a", 9, 0)], t.schema))
    assert [r.v for r in t.get("a").collect()] == [9]
    t.delete(spark.createDataFrame([("a",)], "k string"))
    again = store.KeyedTable(spark, f"{tmp_path}/t", t.schema, "k", "seq").create()
    assert [r.k for r in again.snapshot().collect()] == ["b"]
    again.clear()
    assert again.snapshot().count() == 0


def test_sql_guard(spark):
    spark.createDataFrame([(i, "x") for i in range(9)], "a int, b string").createOrReplaceTempView("things")
    spark.range(1).createOrReplaceTempView("_hidden")
    assert sqlguard.tables(spark) == ["things"]
    text = sqlguard.describe(spark, ["things", "nope"])
    assert "a int" in text and "Error: nope" in text
    assert sqlguard.query(spark, "SELECT * FROM things").count() == 5
    assert sqlguard.query(spark, "SELECT * FROM things LIMIT 7").count() == 7
    assert sqlguard.query(spark, "WITH t AS (SELECT * FROM things) SELECT * FROM t LIMIT 7").count() == 7
    assert sqlguard.query(spark, "SELECT * FROM things LIMIT 7", ceiling=6).count() == 6
    # A limit elsewhere in the statement, or its name in a text, is no limit of the result.
    for sql in ("SELECT t.a FROM things t CROSS JOIN (SELECT 1 AS one LIMIT 1)", "SELECT a, 'GlobalLimit' AS x FROM things", "WITH u AS (SELECT 1 AS one LIMIT 1) SELECT a FROM things, u", "SELECT a FROM things WHERE a >= (SELECT min(a) FROM things LIMIT 1)", "(SELECT a FROM things LIMIT 8) UNION ALL (SELECT a FROM things LIMIT 8)"):
        assert sqlguard.query(spark, sql).count() == 5, sql
    for sql in ("SELECT '\nInsert into x' AS a", "SELECT 'DROP TABLE things' AS `Set`", "SELECT a AS `Command` FROM things", "VALUES (1)", "FROM things SELECT a"):
        assert sqlguard.query(spark, sql).count() >= 1, sql
    assert sqlguard.query(spark, "WITH t AS (SELECT max(a) AS m FROM things) SELECT m FROM t").first().m == 8
    for bad in ("DROP TABLE things", "INSERT INTO things VALUES (1, 'y')", "CREATE TABLE z AS SELECT 1", "DELETE FROM things", "SET x = 1", "TRUNCATE TABLE things", "CACHE TABLE things", "UPDATE things SET a = 1", "FROM things INSERT INTO z SELECT a", "WITH t AS (SELECT 1) INSERT INTO things SELECT * FROM t", "EXPLAIN SELECT 1", "SELECT reflect('java.lang.System', 'gc')", "SELECT * FROM things WHERE a IN (SELECT java_method('java.lang.System', 'nanoTime'))"):
        assert sqlguard.answer(spark, bad) == (None, "Error: only queries are run"), bad
    assert sqlguard.answer(spark, "SELECT nope FROM things")[1].startswith("Error: UNRESOLVED")
    assert sqlguard.answer(spark, "SELEC 1")[1].startswith("Error: PARSE")
    with pytest.raises(sqlguard.Refused):
        sqlguard.query(spark, "SELECT 1", approve=lambda s: False)


def test_workflow(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", []), (3, None, None)], "k int, kind string, xs array<int>")
    add = lambda n: lambda d: d.withColumn("n", F.lit(n))
    assert workflow.sequence(add(1), add(2))(df).first().n == 2
    both = workflow.branches("k", x=lambda d: d.select("k", F.col("k").alias("x")), y=lambda d: d.where("k > 1").select("k", (F.col("k") * 2).alias("y")))(df)
    assert {(r.k, r.x, r.y) for r in both.collect()} == {(1, 1, None), (2, 2, 4), (3, 3, 6)}
    routed = workflow.routed(F.col("kind"), a=add(10))(df)
    assert {(r.k, r.n) for r in routed.collect()} == {(1, 10), (2, None), (3, None)}
    assert {r.k: r.results for r in workflow.each_item(df, "k", "xs", lambda x: x + 1).collect()} == {1: [2, 3], 2: None, 3: None}
    grown = workflow.until(df.select("k"), lambda d: d.withColumn("k", F.col("k") + 1), F.col("k") >= 3, 2)
    assert sorted(r.k for r in grown.collect()) == [3, 3, 4]
    many = spark.range(200).withColumnRenamed("id", "k")
    for kept in (workflow.until(many, lambda d: d.withColumn("x", F.rand()), F.col("x") > 0.5, 3), workflow.routed(F.when(F.rand() > 0.5, "a"), a=add(1))(many)):
        assert sorted(r.k for r in kept.collect()) == list(range(200))  # what chance gives is seen once
    drawn = workflow.branches("k", x=lambda d: d.select("k", F.col("r").alias("x")), y=lambda d: d.select("k", F.col("r").alias("y")))(many.withColumn("r", F.rand()))
    assert drawn.where("x = y and x = r").count() == 200
    assert workflow.until(many, lambda d: d, F.lit(True), 0).count() == 200
    call = workflow.structured(lambda t: '{"a": 1}' if t == "a" else "broken", "struct<a:int>")
    assert [r.x and r.x.a for r in df.select("k", call(F.col("kind")).alias("x")).orderBy("k").collect()] == [1, None, None]
    assert workflow.mapped(df.select("k"), lambda p: p + 1, "k int").agg(F.sum("k")).first()[0] == 9
    c = workflow.Catalogue()
    c.register(test_files) if test_files.__doc__ else None
    with pytest.raises(ValueError):
        c.register(lambda: None)


def beats(spark):
    rows = [("a", t, i) for i, t in enumerate((0, 2, 4, 6, 40, 42))] + [("b", t, i) for i, t in enumerate((0, 2))]
    return spark.createDataFrame(rows, "agent_id string, t long, sequence long").select("agent_id", F.timestamp_seconds("t").alias("ts"), "sequence", F.lit(True).alias("alive"))


def test_supervisor(spark):
    got = {}
    for r in H.supervised(beats(spark), [5.0, 10.0, 15.0, 16.0, 41.0]).orderBy("check_at").collect():
        got.setdefault(r.agent_id, []).append((r.action, r.consecutive_failures, r.backoff_seconds, r.total_restarts))
    # b is restarted at 15, skipped within the wait of 2 s, and restarted again later.
    assert [x[0] for x in got["a"]] == ["healthy", "healthy", "restarted", "backoff_skipped", "healthy"]
    assert got["b"] == [("healthy", 0, 0.0, 0), ("healthy", 0, 0.0, 0), ("restarted", 0, 2.0, 1), ("backoff_skipped", 1, 2.0, 1), ("restarted", 0, 4.0, 2)]
    h = {r.agent_id: (r.age, r.healthy) for r in H.health(beats(spark), 50.0).collect()}
    assert h == {"a": (8.0, True), "b": (48.0, False)}
    acts = H.supervised(beats(spark), [5.0, 10.0, 15.0])
    assert H.action_log(acts, "restarted").count() == 2 and H.action_log(acts, n=3).count() == 3


def test_streams(spark, tmp_path):
    beats(spark).repartition(3).write.parquet(f"{tmp_path}/in")
    src = H.source(spark, f"{tmp_path}/in")
    last = H.merged(H.run_to_end(H.latest(src), f"{tmp_path}/o1", "update", f"{tmp_path}/c1"), "agent_id")
    assert {r.agent_id: r.sequence for r in last.collect()} == {r.agent_id: r.sequence for r in H.latest(beats(spark)).collect()}
    done = H.run_to_end(H.windowed(src, "ts", "10 seconds", "agent_id", "1 hour"), f"{tmp_path}/o2", "complete", f"{tmp_path}/c2")
    want = H.windowed(beats(spark), "ts", "10 seconds", "agent_id")
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_that_is_repeated(spark, tmp_path):
    """The sink fails after a write: the batch comes again, and each row is there once."""
    rows = spark.range(90).select(F.col("id").cast("string").alias("agent_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("sequence"), F.lit(True).alias("alive"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    tried = []
    run = lambda fail: H.run_to_end(H.source(spark, f"{tmp_path}/in"), f"{tmp_path}/out", "append", f"{tmp_path}/c", fail)
    with pytest.raises(StreamingQueryException):
        run(lambda batch: tried.append(batch) or batch == 1)
    got = run(lambda batch: tried.append(batch))
    assert tried == [0, 1, 1, 2] and sorted(r.sequence for r in got.collect()) == list(range(90))
    assert {r.batch for r in got.collect()} == {0, 1, 2}


def test_supervisor_stream(spark, tmp_path):
    """Timers give the actions of the batch version, over restarts, agents that come late, and heartbeats between the same two checks."""
    r = random.Random(1)
    rows = sorted([(f"a{r.randrange(6)}", r.uniform(0, 200), i) for i in range(120)] + [("late", 150.0, 1000), ("clock", 10000.0, 2000)], key=lambda x: x[1])
    all_ = spark.createDataFrame(rows, "agent_id string, t double, sequence long").select("agent_id", F.timestamp_seconds("t").alias("ts"), "sequence", F.lit(True).alias("alive"))
    checks, t = [5.0 + 7 * i for i in range(28)], F.col("ts").cast("double")
    for low, high in ((0, 60), (60, 140), (140, 20000)):
        all_.where((t >= low) & (t < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        acts = H.run_to_end(H.supervise_stream(H.source(spark, f"{tmp_path}/in"), 5.0, 7.0, checks[-1]), f"{tmp_path}/out", "append", f"{tmp_path}/c")
    kept = lambda df: sorted(map(tuple, df.where("agent_id <> 'clock'").collect()))
    assert kept(acts.drop("batch")) == kept(H.supervised(all_, checks))


def test_expiry_by_the_state_store(spark, tmp_path):
    def beat(agent: str, n: int):
        spark.createDataFrame([(agent, n)], "agent_id string, sequence long").select("agent_id", F.timestamp_seconds(F.lit(n)).alias("ts"), "sequence", F.lit(True).alias("alive")).write.mode("append").parquet(f"{tmp_path}/in")
        return H.run_to_end(H.arrivals(H.source(spark, f"{tmp_path}/in"), 15.0), f"{tmp_path}/out", "append", f"{tmp_path}/c", once=True)

    beat("a", 1)
    beat("a", 2)
    time.sleep(16)
    got = beat("a", 3)
    assert [(r.event, r.beats) for r in got.orderBy("batch").collect()] == [("joined", 1), ("seen", 2), ("joined", 1)]


@pytest.fixture(scope="module")
def many_files(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(f"{at}/events.parquet")
    return str(at)


@pytest.mark.parametrize("name, folder, most", [("resumed_stream", "beats", 3), ("supervisor_stream", "supervised", 4)])
def test_batches_of_a_stream_follow_its_runs(spark, sf, many_files, name, folder, most):
    """Input of many files, which several tasks write, is one batch a run (and one without data where timers are due)."""
    from millrace.queries import registry
    from millrace.sources.shared import shared_dir

    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.rglob(f"{folder}-*"))
    got = sorted(registry.queries()[name](spark, many_files).collect())
    (at,) = set(root.rglob(f"{folder}-*")) - before
    assert len(list((at / "out").glob("batch=*"))) <= most < len(list((at / "in").glob("*.parquet")))
    assert got == sorted(registry.queries()[name](spark, sf).collect())
