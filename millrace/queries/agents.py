"""Queries of agent scores, keyed state, heartbeats, simulation and text metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.operators import agents, sim, state
from millrace.plans import workflow
from millrace.queries.registry import query
from millrace.sources.shared import shared_dir
from millrace.streaming import heartbeats

NOW = 1706659200.0  # 2024-01-31 00:00:00 UTC, after the last event
_TS = "epoch(ts)"


def _bids(t):
    k = F.col("s_suppkey")
    b = t("supplier").select((k % 7).alias("task"), k.alias("agent_id"), F.round(F.abs(F.col("s_acctbal")) / 10000, 4).alias("confidence"), F.round((k % 13) / 100, 4).alias("cost"), (k % 9).cast("double").alias("eta_minutes"), k.alias("seq"))
    r = t("lineitem").groupBy(F.col("l_suppkey").alias("agent_id")).agg(F.count_if(F.col("l_returnflag") != "R").alias("successes"), F.count_if(F.col("l_returnflag") == "R").alias("failures"))
    return b, r


@query("""WITH r AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS f, count(*) AS n FROM lineitem GROUP BY 1),
u AS (SELECT s_suppkey % 7 AS task, s_suppkey AS agent_id, round(round(abs(s_acctbal) / 10000, 4) * (1 - coalesce(least(1.0::DOUBLE, 2.0::DOUBLE * f / n), 0)) - round((s_suppkey % 13) / 100, 4) - (s_suppkey % 9) / 60.0::DOUBLE, 6) AS utility FROM supplier LEFT JOIN r ON s_suppkey = l_suppkey)
SELECT task, agent_id, utility, row_number() OVER (PARTITION BY task ORDER BY utility DESC, agent_id)::INT AS place FROM u QUALIFY place <= 2""")
def auction_winner(t, spark):
    return agents.auction(*_bids(t))


@query("SELECT l_suppkey AS agent_id, round(least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / count(*)), 6) AS penalty FROM lineitem GROUP BY 1")
def reputation_penalty(t, spark):
    return _bids(t)[1].select("agent_id", F.round(agents.penalty(F.col("successes"), F.col("failures")), 6).alias("penalty"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END AS level, CASE WHEN (event_id % 4) <= (CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END) THEN 'b' ELSE 'a' END AS yields FROM events")
def priority_yield(t, spark):
    level = agents.priority(F.col("event_type"), {"error": 3, "purchase": 2})
    return t("events").select("event_id", level.alias("level"), agents.yielding(F.lit("a"), level, F.lit("b"), F.col("event_id") % 4).alias("yields"))


@query("SELECT * FROM (VALUES ('Push', 'Yield', 3, 1), ('Yield', 'Push', 1, 3)) AS v(p1, p2, u1, u2)")
def nash_2x2(t, spark):
    rows = [("Push", "Push", 0, 0), ("Push", "Yield", 3, 1), ("Yield", "Push", 1, 3), ("Yield", "Yield", 2, 2)]
    return agents.pure_equilibria(spark.createDataFrame(rows, "p1 string, p2 string, u1 int, u2 int"))


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 3 AND l_tax <= 0.02 AS ok FROM lineitem")
def verdicts(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", agents.verdict(F.col("l_quantity"), F.col("l_tax"), 3.0, 0.02).alias("ok"))


@query(f"SELECT event_id, event_type FROM events WHERE {NOW} - {_TS} < 86400 * (1 + event_id % 20)")
def ttl_fresh(t, spark):
    e = t("events").select("event_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("t"), (86400 * (1 + F.col("event_id") % 20)).alias("ttl"))
    return state.read_fresh(e, "t", "ttl", NOW).select("event_id", "event_type")


def _beats(t):
    return t("events").select(F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"), F.lit(True).alias("alive"))


@query(f"SELECT 'agent-' || user_id AS agent_id, round({NOW} - max({_TS}), 3) AS age, {NOW} - max({_TS}) <= 90000 AS healthy FROM events GROUP BY 1")
def heartbeat_health(t, spark):
    return heartbeats.health(_beats(t), NOW, 90000.0)


@query("SELECT i::BIGINT AS attempt, least(2.0 * power(2, i - 1), 60.0)::DOUBLE AS wait FROM range(1, 11) AS r(i)")
def backoff(t, spark):
    return state.backoff_table(spark, 10)


_ACTIONS = f"""WITH RECURSIVE c AS (SELECT i, {NOW} - 86400 * (11 - i) AS tm FROM range(1, 11) AS r(i)),
s AS (SELECT 'agent-' || user_id AS agent_id, i, tm, max({_TS}) FILTER ({_TS} <= tm) AS seen FROM events, c GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT agent_id, 0::BIGINT AS i, 0.0::DOUBLE AS tm, 'none' AS action, 0 AS failures, 0.0::DOUBLE AS wait, 0 AS restarts FROM s
UNION ALL SELECT agent_id, s.i, s.tm, CASE WHEN ok THEN 'healthy' WHEN skip THEN 'backoff_skipped' ELSE 'restarted' END, CASE WHEN ok OR NOT skip THEN 0 ELSE n END, CASE WHEN ok THEN 0.0 ELSE w END, restarts + (NOT ok AND NOT skip)::INT
  FROM f JOIN s USING (agent_id), LATERAL (SELECT coalesce(s.tm - seen <= 90000, false) AS ok, failures + 1 AS n), LATERAL (SELECT least(40000.0 * power(2, n - 1), 400000.0) AS w), LATERAL (SELECT action = 'restarted' AND s.tm - f.tm < w AS skip) WHERE s.i = f.i + 1)
SELECT agent_id, tm AS check_at, action, failures::INT AS consecutive_failures, wait::DOUBLE AS backoff_seconds, restarts::INT AS total_restarts FROM f WHERE i > 0"""


@query(_ACTIONS)
def supervisor_actions(t, spark):
    return heartbeats.supervised(_beats(t), [NOW - 86400 * k for k in range(10, 0, -1)], 90000.0, 40000.0, 2.0, 400000.0)


@query(_ACTIONS)
def supervisor_stream(t, spark):
    """The same checks by timers over a stream in two runs, with a clock's heartbeat behind all others."""
    at, beats = f"{shared_dir(spark)}/supervised-{uuid.uuid4().hex}", _beats(t)
    clock = spark.range(1).select(F.lit("clock").alias("agent_id"), F.timestamp_seconds(F.lit(NOW + 86400)).alias("ts"), F.lit(0).cast("long").alias("sequence"), F.lit(True).alias("alive"))
    middle = F.col("ts").cast("double") < NOW - 86400 * 6
    for part in (beats.where(middle), beats.where(~middle).unionByName(clock)):
        part.write.mode("append").parquet(f"{at}/in")
        # A run's files are one batch: the watermark of one file would make the heartbeats of the next one late.
        stream = heartbeats.supervise_stream(heartbeats.source(spark, f"{at}/in", heartbeats.ALL), NOW - 86400 * 10, 86400.0, NOW - 86400, 90000.0, 40000.0, 2.0, 400000.0)
        out = heartbeats.run_to_end(stream, f"{at}/out", "append", f"{at}/checkpoint")
    return out.where("agent_id <> 'clock'").drop("batch")


@query(f"""WITH s AS (SELECT user_id AS k, epoch(max(ts)) AS ts, count(*)::INT AS v FROM events GROUP BY 1)
SELECT k, v + (k % 3 = 0)::INT AS expected_version, CASE WHEN NOT ({NOW} - ts < 90000) THEN 'missing' ELSE 'conflict' END AS problem FROM s WHERE NOT ({NOW} - ts < 90000) OR k % 3 = 0""")
def optimistic_update(t, spark):
    table = t("events").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").cast("timestamp").cast("double").alias("timestamp"), F.count("*").cast("int").alias("version")).withColumn("ttl_seconds", F.lit(90000))
    updates = table.select("k", (F.col("version") + (F.col("k") % 3 == 0).cast("int")).alias("expected_version"), F.lit("moved").alias("status"))
    return state.optimistic(table, updates, "k", NOW)[1].select("k", "expected_version", "problem")


@query("""WITH RECURSIVE w AS (SELECT user_id AS k, epoch(ts) AS ts, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT k, i, 1 AS version, ts AS created, status FROM w WHERE i = 1
UNION ALL SELECT w.k, w.i, CASE WHEN w.ts - f.created < 86400 THEN f.version + 1 ELSE 1 END, CASE WHEN w.ts - f.created < 86400 THEN f.created ELSE w.ts END, w.status FROM f JOIN w ON w.k = f.k AND w.i = f.i + 1)
SELECT k, arg_max(version, i)::INT AS version, arg_max(status, i) AS status FROM f GROUP BY 1""")
def versioned_state(t, spark):
    w = t("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("o"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_type").alias("status"))
    return state.versioned(w, "k", "o", 86400.0).select("k", "version", "status")


@query("SELECT user_id, event_id, event_type FROM (SELECT * FROM events WHERE event_type <> 'error') WHERE user_id % 10 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id >= 5000 DESC, event_id DESC) = 1")
def kv_upsert_delete(t, spark):
    e = t("events").where("event_type <> 'error'").select("user_id", "event_id", "event_type")
    table = state.put(e.where("event_id < 5000"), e.where("event_id >= 5000"), "user_id", "event_id")
    return state.deleted(table, e.select("user_id").where("user_id % 10 = 0"), "user_id")


@query("SELECT s.user_id AS shipment_id, e.event_type, s.status AS old_status, CASE e.event_type WHEN 'error' THEN 'delayed' ELSE 'delivered' END AS new_status, s.user_id || ': ' || s.status || ' -> ' || CASE e.event_type WHEN 'error' THEN 'delayed' ELSE 'delivered' END AS notice FROM events e JOIN (SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1) s USING (user_id) WHERE e.event_type IN ('error', 'purchase')")
def status_propagation(t, spark):
    e = t("events").select(F.col("user_id").alias("shipment_id"), "event_type", "event_id")
    s = e.groupBy("shipment_id").agg(F.max_by("event_type", "event_id").alias("status"))
    return state.propagated(e, s, {"error": "delayed", "purchase": "delivered"})


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS at, strftime(ts, '%b') AS month FROM events")
def clock_labels(t, spark):
    return t("events").select("event_id", heartbeats.clock(F.col("ts").cast("timestamp").cast("long")).alias("at"), F.date_format("ts", "MMM").alias("month"))


@query("SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'fix' WHEN 'purchase' THEN 'ship' END AS step FROM events")
def routed_events(t, spark):
    to = lambda name: lambda d: d.withColumn("step", F.lit(name))
    run = workflow.routed(F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")), error=to("fix"), purchase=to("ship"))
    return run(t("events").select("event_id", "event_type"))


@query("SELECT o_orderkey, list_transform(range(1, 1 + (o_orderkey % 4)::INT), lambda i: i * 10)::VARCHAR AS results FROM orders WHERE o_orderkey % 4 > 0")
def mapped_items(t, spark):
    o = t("orders").where("o_orderkey % 4 > 0").select("o_orderkey", F.sequence(F.lit(1), (F.col("o_orderkey") % 4).cast("int")).alias("xs"))
    return workflow.each_item(o, "o_orderkey", "xs", lambda x: x * 10).select("o_orderkey", F.concat(F.lit("["), F.array_join(F.col("results").cast("array<string>"), ", "), F.lit("]")).alias("results"))


@query("SELECT agent, i, dx, dy FROM (VALUES ('Drone_B', 1, -5.0, -10.0), ('Drone_C', 2, 5.0, -10.0), ('Drone_D', 3, -5.0, -20.0), ('Drone_E', 4, 5.0, -20.0)) AS v(agent, i, dx, dy)")
def formation_offsets(t, spark):
    return sim.formation(spark, "grid", 5, 10.0)


@query()
def swarm_metrics(t, spark):
    kind = F.element_at(F.array(F.lit("grid"), F.lit("line"), F.lit("v_shape")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    runs = t("nation").select(
        F.col("n_name").alias("run"), kind.alias("formation"), (4 + F.col("n_nationkey") % 3).alias("drones"), (8.0 + F.col("n_regionkey")).alias("spacing"), F.lit(160).alias("steps"), F.lit(0.1).alias("dt"),
        F.array(F.struct(F.lit(20.0).alias("x"), F.lit(40.0).alias("y"), F.lit(3.5).alias("radius"))).alias("obstacles"),
    )
    return sim.swarm_metrics(sim.simulated(runs))


@query()
def rouge_scores(t, spark):
    """Each answer against the turn before it, both whole."""
    c = t("conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return c.select("conv_id", "turn", metrics.rouge(F.col("text"), F.col("before")).alias("r")).select("conv_id", "turn", "r.*")
