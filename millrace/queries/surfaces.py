"""Queries of sources and sinks, the SQL surface, workflows and streams: each writes or registers whole tables and reads them again."""

from __future__ import annotations

import contextlib
import uuid
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.functions import json_text, subword, text
from millrace.operators import agents, nested, sets, sim
from millrace.plans import sqlguard, workflow
from millrace.queries.registry import query
from millrace.sources import files, sqlite
from millrace.sources.shared import shared_dir
from millrace.streaming import heartbeats


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks.


@query("SELECT * FROM (VALUES (1::BIGINT, 'low', 0.5::DOUBLE), (2::BIGINT, 'high', NULL)) AS v(k, name, share)")
def literal_rows(t, spark):
    return files.literal(spark, [(1, "low", 0.5), (2, "high", None)], "k long, name string, share double")


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND text <> ''")
def csv_files(t, spark):
    at, d = _folder(spark, "csv"), t("documents").where("text <> ''").select("doc_id", "source", "lang", "text")
    files.write_csv(d.where("doc_id % 2 = 0"), f"{at}/part_a")
    files.write_csv(d.where("doc_id % 2 <> 0"), f"{at}/part_b")
    back = files.csv(spark, f"{at}/part_*", "doc_id long, source string, lang string, text string", ["doc_id", "lang", "text"])
    return back.select("doc_id", "lang", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS place, n_nationkey, n_name FROM nation")
def csv_indexed(t, spark):
    at = _folder(spark, "csv")
    files.write_csv(t("nation").select("n_nationkey", "n_name"), at, index=F.col("n_nationkey"))
    return files.csv(spark, at, "place int, n_nationkey int, n_name string")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines(t, spark):
    at, c = _folder(spark, "json"), t("conversations")
    files.write_json(c, at)
    return spark.read.schema(c.schema).json(at).select("conv_id", "turn", "role", "text")


@query("SELECT r_regionkey, r_name FROM region")
def json_list(t, spark):
    at = _folder(spark, "json")
    t("region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value")).write.text(at)
    return files.json_documents(spark, at, "r_regionkey int, r_name string")


def _region_files(t, spark):
    """A text file of the sorted names of each region's nations."""
    at = _folder(spark, "text")
    t("nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(at)
    return at


def _region():
    return F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region")


@query("SELECT n_regionkey AS region, string_agg(n_name || chr(10), '' ORDER BY n_name) AS text FROM nation GROUP BY 1")
def text_files(t, spark):
    return files.text_documents(spark, _region_files(t, spark) + "/*").select(_region(), "text")


@query("SELECT n_regionkey AS region, sum(length(n_name) + 1)::BIGINT AS length, sum(length(n_name) + 1)::BIGINT AS converted FROM nation GROUP BY 1")
def folder_files(t, spark):
    found = files.folder(spark, _region_files(t, spark), (".txt",))
    read = files.converted(found, lambda b: b.decode()).select("path", F.length("text").cast("long").alias("converted"))
    return found.select("path", "length").join(read, "path").select(_region(), "length", "converted")


@query("SELECT 'train' AS split, o_orderkey FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT 'test', o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def split_load(t, spark):
    at, o = _folder(spark, "split"), t("orders").select("o_orderkey")
    files.write_batches(o.where("o_orderkey % 5 > 0"), f"{at}/train")
    files.write_batches(o.where("o_orderkey % 5 = 0"), f"{at}/test")
    return sets.concat([files.split_of(spark, at, s).select(F.lit(s).alias("split"), "o_orderkey") for s in ("train", "test")])


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 100 AND o_totalprice > 1000")
def sqlite_scan(t, spark):
    """Orders exported to SQLite and read again in ranges of rowids; SQLite decides the filters on numbers and texts."""
    at, o = _folder(spark, "sqlite"), t("orders")
    sqlite.write_sqlite(o.repartition(3, "o_orderkey"), at, "orders")
    back = sqlite.read_sqlite(spark, at, "orders", o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").schema, rows=2000)
    return back.where("o_orderstatus = 'F' AND o_custkey >= 100 AND o_totalprice > 1000").drop("o_orderstatus")


@query("SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' AS name FROM events")
def stamped_names(t, spark):
    return t("events").select("event_id", files.stamped("run", "csv", F.date_trunc("second", "ts")).alias("name"))


# The SQL surface.


@contextmanager
def _views(spark, **frames):
    """Temporary views that go when they have been used: a query that was analysed no longer needs them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)


@query("SELECT * FROM (VALUES ('guarded_nation'), ('guarded_region')) AS v(name)")
def sql_tables(t, spark):
    with _views(spark, guarded_nation=t("nation"), guarded_region=t("region"), _guarded_hidden=t("region")):
        return spark.createDataFrame([(n,) for n in sqlguard.tables(spark) if "guarded_" in n], "name string")


@query("SELECT 'guarded_region (r_regionkey int, r_name string)' || chr(10) || string_agg('(' || r_regionkey || ', ''' || r_name || ''')', chr(10) ORDER BY r_regionkey) || chr(10) || chr(10) || 'Error: guarded_none: TABLE_OR_VIEW_NOT_FOUND' AS text FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)")
def sql_described(t, spark):
    with _views(spark, guarded_region=t("region").orderBy("r_regionkey")):
        return spark.createDataFrame([(sqlguard.describe(spark, ["guarded_region", "guarded_none"]),)], "text string")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def sql_capped(t, spark):
    with _views(spark, guarded_nation=t("nation")):
        return sqlguard.query(spark, "SELECT n_nationkey, n_name FROM guarded_nation ORDER BY n_nationkey DESC")


@query("""SELECT 'SELECT count(*) FROM guarded_nation' AS statement, count(*)::VARCHAR AS outcome FROM nation
UNION ALL SELECT * FROM (VALUES ('SELECT ''Insert'' FROM guarded_nation', 'Insert'), ('DELETE FROM guarded_nation', 'Error: only queries are run'), ('DROP VIEW guarded_nation', 'Error: only queries are run'), ('INSERT INTO guarded_nation VALUES (1, ''x'', 1)', 'Error: only queries are run'),
('SELECT nope FROM guarded_nation', 'Error: UNRESOLVED_COLUMN.WITH_SUGGESTION'), ('SELEC 1', 'Error: PARSE_SYNTAX_ERROR'), ('SELECT 1 AS refused', 'Error: not approved')) AS v(statement, outcome)""")
def sql_answers(t, spark):
    said = ["SELECT count(*) FROM guarded_nation", "SELECT 'Insert' FROM guarded_nation", "DELETE FROM guarded_nation", "DROP VIEW guarded_nation", "INSERT INTO guarded_nation VALUES (1, 'x', 1)", "SELECT nope FROM guarded_nation", "SELEC 1", "SELECT 1 AS refused"]
    out = []
    with _views(spark, guarded_nation=t("nation")):
        for s in said:
            rows, error = sqlguard.answer(spark, s, approve=lambda q: "refused" not in q)
            out.append((s, error or str(rows.first()[0])))
    return spark.createDataFrame(out, "statement string, outcome string")


@query("SELECT * FROM (VALUES ('tables', 'Names of the tables and views; system names are hidden.'), ('describe', 'Columns and sample rows of each table; an unknown name gives its error text, and stops no other.'), ('answer', '(rows, None) or (None, ''Error: ...''): for callers that pass errors on as text.')) AS v(name, description)")
def operations(t, spark):
    c = workflow.Catalogue()
    for f in (sqlguard.tables, sqlguard.describe, sqlguard.answer):
        c.register(f)
    return spark.createDataFrame(list(c.described().items()), "name string, description string")


# Workflows.


@query("SELECT event_id, value * 2 + 1 AS y FROM events WHERE event_type <> 'error'")
def sequence_steps(t, spark):
    run = workflow.sequence(lambda d: d.where("event_type <> 'error'"), lambda d: d.withColumn("y", F.col("value") * 2), lambda d: d.withColumn("y", F.col("y") + 1))
    return run(t("events")).select("event_id", "y")


@query("SELECT event_id, length(props)::INT AS size, CASE WHEN event_type = 'error' THEN upper(event_type) END AS loud FROM events")
def fan_out(t, spark):
    run = workflow.branches("event_id", size=lambda d: d.select("event_id", F.length("props").alias("size")), loud=lambda d: d.where("event_type = 'error'").select("event_id", F.upper("event_type").alias("loud")))
    return run(t("events").select("event_id", "event_type", "props")).select("event_id", "size", "loud")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 + 2 >= 6 THEN o_orderkey % 7 + 2 ELSE o_orderkey % 7 + 4 END AS k FROM orders")
def until_accepted(t, spark):
    o = t("orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("k"))
    return workflow.until(o, lambda d: d.withColumn("k", F.col("k") + 2), F.col("k") >= 6, rounds=2)


@query("SELECT event_id, event_id * 3 AS tripled FROM events")
def batched_map(t, spark):
    return workflow.mapped(t("events").select("event_id"), lambda p: p.assign(tripled=p["event_id"] * 3), "event_id long, tripled long")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE json_extract(props, '$.k')::INT END AS k FROM events")
def structured_output(t, spark):
    asked = F.when(F.col("event_type") == "error", "no JSON").otherwise(F.col("props"))
    call = workflow.structured(lambda prompt: prompt, "struct<k:int>")
    return t("events").select("event_id", F.coalesce(call(asked)["k"], F.lit(-1)).alias("k"))


# Text and nested values.


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role AS speaker, replace(text, chr(10), ' ') AS utterance FROM conversations")
def transcript_turns(t, spark):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))))
    said = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))
    return said.select("conv_id", F.explode(text.speaker_turns(F.col("text"))).alias("x")).select("conv_id", "x.*")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 3 THEN '[{"type": "function", "function": {"name": "' || n_name || '", "description": "", "parameters": {"type": "object", "properties": {}}}}]' WHEN 4 THEN '[{"function": {"name": "é"}, "type": "function"}]' ELSE '[]' END AS tools FROM nation""")
def tool_lists(t, spark):
    k = F.col("n_nationkey") % 5
    given = F.when(k == 0, "").when(k == 1, "not JSON").when(k == 2, '{"name": "x"}').when(k == 3, F.concat(F.lit('[{"name": "'), "n_name", F.lit('"}, 7]'))).otherwise('[{"function": {"name": "é"}}]')
    return t("nation").select("n_nationkey", nested.tool_envelopes(given).alias("tools"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props ELSE '{"error":"no JSON object"}' END AS found FROM events""")
def greedy_json(t, spark):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("It is "), "props", F.lit(" so far"))).otherwise("none {here")
    return t("events").select("event_id", json_text.greedy_json(said).alias("found"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k":' || json_extract(props, '$.k') || '}' WHEN 1 THEN '{"at":"' || event_type || '"}' ELSE '{"k":' || json_extract(props, '$.k') || '}' END AS value FROM events""")
def prefix_json(t, spark):
    k = F.col("event_id") % 3
    key = F.when(k == 0, "stock:1").when(k == 1, "route:1").otherwise("other")
    value = F.when(k == 1, F.concat(F.lit('{"at":"'), "event_type", F.lit('"}'))).otherwise(F.col("props"))
    return t("events").select("event_id", json_text.by_prefix(key, value, {"stock:": "struct<k:int>", "route:": "struct<at:string>"}).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k')::INT ELSE -1 END AS k FROM events")
def parsed_props(t, spark):
    said = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{broken")
    return t("events").select("event_id", F.coalesce(json_text.parsed_or_null(said, "struct<k:int>")["k"], F.lit(-1)).alias("k"))


@query("SELECT p_partkey, p_name AS text FROM part")
def wordpiece_decode(t, spark):
    pieces = F.flatten(F.transform(F.split("p_name", " "), lambda w: F.array(F.substring(w, 1, 2), F.concat(F.lit("##"), F.substring(w, 3, 100)))))
    return t("part").select("p_partkey", subword.wordpiece_text(pieces).alias("text"))


@query("SELECT p_partkey, len(regexp_extract_all(p_name || ', ' || p_type, '\\w+|[^\\w\\s]'))::INT AS n FROM part")
def token_counts(t, spark):
    return t("part").select("p_partkey", subword.token_counter()(F.concat_ws(", ", "p_name", "p_type")).alias("n"))


@query("SELECT p_partkey, unnest([p_name, p_type]) AS what, unnest([p_brand, p_size::VARCHAR]) AS value FROM part")
def zipped_rows(t, spark):
    p = t("part").select("p_partkey", F.array("p_name", "p_type").alias("what"), F.array(F.col("p_brand"), F.col("p_size").cast("string")).alias("value"))
    return nested.flattened(p.select(F.transform(sets.zipped("what", "value"), lambda z: F.struct(F.col("p_partkey"), z["what"].alias("what"), z["value"].alias("value"))).alias("rows")), "rows")


@query("""WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS shown, max_by(text, turn) AS asked FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id, shown || chr(10) || chr(10) || chr(10) || asked AS prompt FROM c""")
def few_shot_prompts(t, spark):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    c = t("conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(rows, "\n").alias("shown"), F.max_by("text", "turn").alias("asked"))
    return c.select("conv_id", sets.few_shot(c, "shown", "asked").alias("prompt"))


# Agents.


@query("""SELECT l_suppkey AS agent_id, (10 + count(*) FILTER (l_returnflag <> 'R'))::BIGINT AS successes, (1 + count(*) FILTER (l_returnflag = 'R'))::BIGINT AS failures FROM lineitem GROUP BY 1""")
def recorded_outcomes(t, spark):
    new = t("lineitem").select(F.col("l_suppkey").alias("agent_id"), (F.col("l_returnflag") != "R").alias("ok"))
    held = new.select("agent_id").distinct().select("agent_id", F.lit(10).cast("long").alias("successes"), F.lit(1).cast("long").alias("failures"))
    return agents.recorded(held, new)


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE - 25 AS x, l_linenumber::DOUBLE * 4 - 12 AS y FROM lineitem), n AS (SELECT *, sqrt(x * x + y * y) AS len FROM d)
SELECT l_orderkey, l_linenumber, round(CASE WHEN len > 10 THEN x / len * 10 ELSE x END, 6) + 0.0 AS x, round(CASE WHEN len > 10 THEN y / len * 10 ELSE y END, 6) + 0.0 AS y FROM n""")
def clamped_steps(t, spark):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    step = sim.clamped(sim.minus(point(F.col("l_quantity"), F.col("l_linenumber") * 4), point(F.lit(25), F.lit(12))), 10.0)
    return t("lineitem").select("l_orderkey", "l_linenumber", step.alias("s")).select("l_orderkey", "l_linenumber", (F.round("s.x", 6) + 0.0).alias("x"), (F.round("s.y", 6) + 0.0).alias("y"))


# Streams.


@query("SELECT user_id::VARCHAR AS agent_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS sequence, true AS alive FROM events GROUP BY 1")
def resumed_stream(t, spark):
    """Heartbeats read as a stream in three runs over one checkpoint. The second fails between a batch's write and its commit;
    the third repeats the batch and goes on with what has come since."""
    at = _folder(spark, "beats")
    beats = t("events").select(F.col("user_id").cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"), F.lit(True).alias("alive"))
    for part, fail in ((0, None), (1, lambda batch: True), (2, None)):
        files.write_batches(beats.where(F.col("sequence") % 3 == part), f"{at}/in")
        with contextlib.suppress(*[StreamingQueryException] if fail else []):
            out = heartbeats.run_to_end(heartbeats.latest(heartbeats.source(spark, f"{at}/in", heartbeats.ALL)), f"{at}/out", "update", f"{at}/checkpoint", fail)
    return heartbeats.merged(out, "agent_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
