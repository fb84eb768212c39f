"""Queries of the cleaning, join, aggregate, window, set and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import aggs, clean, joins, sets, windows
from millrace.queries.registry import query

HOLES = "SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v5, CASE WHEN event_id % 5 > 1 THEN user_id END AS u5 FROM events"


def _holes(t):
    e, k = t("events"), F.col("event_id") % 5
    return e.withColumns({"v5": F.when(k != 0, F.col("value")), "u5": F.when(k > 1, F.col("user_id"))})


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


# Cleaning.


@query(f"""WITH e AS ({HOLES}) SELECT 'v5' AS column_name, avg((v5 IS NULL)::INT) AS ratio FROM e UNION ALL SELECT 'u5', avg((u5 IS NULL)::INT) FROM e
UNION ALL SELECT 'props', avg((props IS NULL)::INT) FROM e""")
def missing_ratio(t, spark):
    return clean.missing_ratios(_holes(t), ["v5", "u5", "props"])


@query(f"SELECT event_id, v5, event_type FROM ({HOLES})")
def drop_sparse_columns(t, spark):
    return clean.drop_sparse(_holes(t).select("event_id", "v5", "u5", "event_type"))


@query("SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS DOUBLE) AS brand_no, try_cast(nullif(regexp_extract(p_name, '(\\d+)', 1), '') AS DOUBLE) AS name_no FROM part")
def extract_digits(t, spark):
    return t("part").select("p_partkey", clean.leading_digits(F.col("p_brand")).alias("brand_no"), clean.leading_digits(F.col("p_name")).alias("name_no"))


@query("SELECT p_partkey, try_cast(regexp_replace('$' || format('{:,.2f}', p_retailprice), '[$,]', '', 'g') AS DOUBLE) AS price FROM part")
def currency_to_num(t, spark):
    text = F.concat(F.lit("$"), F.format_number("p_retailprice", 2))
    return t("part").select("p_partkey", clean.currency(text).alias("price"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def multi_date_parse(t, spark):
    k = F.pmod("o_orderkey", F.lit(5))
    text = F.lit(None).cast("string")
    for i, f in enumerate(clean.DATE_FORMATS):
        text = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(text)
    return t("orders").select("o_orderkey", _day(clean.mixed_date(text)).alias("day"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(t, spark):
    return clean.first_of_each(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT (count(*) - count(DISTINCT (user_id, event_type)))::BIGINT AS n FROM events")
def dup_key_count(t, spark):
    return clean.repeated_keys(t("events"), ["user_id", "event_type"])


@query(f"SELECT DISTINCT u5 FROM ({HOLES}) WHERE u5 IS NOT NULL")
def distinct_non_null(t, spark):
    return clean.distinct_values(_holes(t), "u5")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity <= 20")
def range_flag_filter(t, spark):
    return clean.between(clean.where_equal(clean.where_equal(t("lineitem"), "l_returnflag", "R"), "l_linestatus", "All"), "l_quantity", 10, 20).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1")
def pass_fail_filter(t, spark):
    return clean.passed(t("labels"), "quality", "Passed").select("doc_id", "quality")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 200 AND length(text) <= 1000")
def length_filter(t, spark):
    return clean.length_above_to(t("documents"), "text", 200, 1000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE coalesce(regexp_matches(text, '(?i)TION'), false) OR coalesce(regexp_matches(source, '(?i)SRC1$'), false)")
def search_ci(t, spark):
    a = clean.search(t("documents"), "TION", ["text"]).select("doc_id", "lang")
    return a.unionByName(clean.search(t("documents"), "SRC1$", ["source"]).select("doc_id", "lang")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 12 THEN 'Child' WHEN p_size <= 17 AND p_size > 12 THEN 'Teen' WHEN p_size <= 24 AND p_size > 17 THEN 'Young Adult' WHEN p_size <= 34 AND p_size > 24 THEN 'Adult'
WHEN p_size <= 50 AND p_size > 34 THEN 'Middle Aged' WHEN p_size <= 65 AND p_size > 50 THEN 'Senior' WHEN p_size <= 100 AND p_size > 65 THEN 'Elderly' END AS label FROM part""")
def age_bins(t, spark):
    return t("part").select("p_partkey", clean.binned(F.col("p_size")).alias("label"))


@query("SELECT o_orderkey, dayname(o_orderdate) AS name, CASE WHEN isodow(o_orderdate) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS label FROM orders")
def weekend_flag(t, spark):
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("name"), clean.weekend_label(F.col("o_orderdate")).alias("label"))


@query("SELECT o_orderkey, trim(split_part(o_orderpriority, '-', 1)) AS a, CASE WHEN contains(o_orderpriority, '-') THEN trim(substr(o_orderpriority, position('-' IN o_orderpriority) + 1)) END AS b FROM orders")
def split_two(t, spark):
    a, b = clean.split_two(F.col("o_orderpriority"), "-")
    return t("orders").select("o_orderkey", a.alias("a"), b.alias("b"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview FROM documents")
def preview(t, spark):
    return t("documents").select("doc_id", clean.preview(F.col("text")).alias("preview"))


@query(f"SELECT event_id, coalesce(v5, 0)::DOUBLE AS v5, coalesce(u5, 0)::INT AS u5 FROM ({HOLES})")
def fill_and_cast(t, spark):
    d = clean.filled(clean.filled(_holes(t), 0.0, ["v5"]), 0, ["u5"])
    return d.select("event_id", "v5", F.col("u5").cast("int").alias("u5"))


@query("SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN 'Passed' ELSE 'Failed' END AS verdict FROM orders")
def rename_select(t, spark):
    o = t("orders").withColumn("verdict", clean.bool_label(F.col("o_orderstatus") == "F", "Passed", "Failed")).drop("o_orderpriority")
    return clean.renamed(o, {"o_orderkey": "id", "o_totalprice": "price", "verdict": "verdict"})


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S') AND trim(p_name) <> ''")
def prefix_non_blank(t, spark):
    return t("part").where(F.startswith("p_type", F.lit("S")) & clean.not_blank(F.col("p_name"))).select("p_partkey", "p_type")


@query("SELECT p_partkey, list_filter([CASE WHEN NOT (p_size BETWEEN 3 AND 40) THEN 'size' END, CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN 'type' END], lambda x: x IS NOT NULL)::VARCHAR AS broken FROM part WHERE NOT (p_size BETWEEN 3 AND 40) OR p_type NOT IN ('ECONOMY', 'PROMO')")
def validation_rejects(t, spark):
    _, bad = clean.valid_rows(t("part"), {"size": F.col("p_size").between(3, 40), "type": F.col("p_type").isin("ECONOMY", "PROMO")})
    return bad.select("p_partkey", F.concat(F.lit("["), F.array_join("broken", ", "), F.lit("]")).alias("broken"))


@query("SELECT doc_id FROM documents WHERE contains(text, '?') OR contains(text, '!')")
def punch_gate(t, spark):
    return t("documents").where(clean.has_punch(F.col("text"))).select("doc_id")


@query("SELECT event_id, k::INT AS step FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k IS NOT NULL")
def split_log_records(t, spark):
    raw = t("events").select("event_id", F.replace("props", F.lit('"k"'), F.lit('"step"')).alias("raw"))
    return clean.split_log(raw)[0].select("event_id", "step")


@query("SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def mod_sample(t, spark):
    return clean.one_in(t("events"), "event_id", 100).select("event_id", "value")


# Joins.


@query("SELECT n_nationkey, n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
def inner_same_key(t, spark):
    return joins.inner(t("nation"), t("customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey").select("n_nationkey", "n_name", "c_custkey")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_diff_key(t, spark):
    return joins.inner_on(t("orders"), t("customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("""WITH n AS (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1), m AS (SELECT s_nationkey k, count(*) m FROM supplier GROUP BY 1)
SELECT sum(n)::BIGINT AS left_rows, sum(m)::BIGINT AS right_rows, sum(n * m)::BIGINT AS joined_rows, count(*) FILTER (m > 1)::BIGINT AS right_repeated FROM n FULL JOIN m USING (k)""")
def fanout_report(t, spark):
    return joins.fan_out(t("customer").withColumnRenamed("c_nationkey", "k"), t("supplier").withColumnRenamed("s_nationkey", "k"), "k")


@query("SELECT s_suppkey, s_nationkey AS k, sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(c_acctbal) AS avg_c_acctbal FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1, 2")
def preagg_join(t, spark):
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return joins.averaged_join(s, t("customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), "k", "c_acctbal")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def checked_join(t, spark):
    return joins.checked(t("nation").withColumnRenamed("n_regionkey", "r_regionkey"), t("region"), "r_regionkey").select("n_nationkey", "n_name", "r_name")


_NATION_BALANCES = "SELECT k, a.b AS bal_prev, s.b AS bal_curr FROM (SELECT c_nationkey k, max(c_acctbal) b FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey k, max(s_acctbal) b FROM supplier GROUP BY 1) s USING (k)"


@query(_NATION_BALANCES)
def suffix_join(t, spark):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("bal"))
    return joins.suffixed(a, t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("bal")), "k", ("_prev", "_curr"))


@query(f"SELECT k, bal_prev AS bal FROM ({_NATION_BALANCES})")
def keep_left_join(t, spark):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("bal"))
    return joins.keep_left(a, t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("bal")), "k")


@query("SELECT c_custkey, o.p AS best FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def lookup_left(t, spark):
    best = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("p"))
    return joins.looked_up(t("customer"), best, "c_custkey", "o_custkey", "p", "best").select("c_custkey", "best")


_DAILY = "SELECT ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events WHERE day(ts) % 2 = 1 GROUP BY 1"
_SPINE = f"WITH d AS ({_DAILY}) SELECT s.day, total FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d) s LEFT JOIN d USING (day)"


def _daily(t):
    return t("events").where(F.dayofmonth("ts") % 2 == 1).groupBy(F.to_date("ts").alias("day")).agg(aggs.exact_sum("value").alias("total"))


def _spine(t):
    return joins.on_spine(_daily(t), "day")


@query(f"SELECT day::VARCHAR AS day, total FROM ({_SPINE})")
def date_spine(t, spark):
    return _spine(t).select(_day("day").alias("day"), "total")


@query("SELECT a.p_brand, count(*)::BIGINT AS pairs, sum(abs(a.p_size - b.p_size))::BIGINT AS spread FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY 1")
def pairs_theta(t, spark):
    return joins.pair_totals(t("part"), "p_brand", "p_partkey", "p_size")


@query("""WITH e AS (SELECT DISTINCT event_id % 40 AS target, user_id % 6 AS agent, event_type AS action FROM events)
SELECT a.target, a.agent AS agent_a, a.action AS action_a, b.agent AS agent_b, b.action AS action_b FROM e a JOIN e b ON a.target = b.target AND a.action <> b.action AND a.agent < b.agent""")
def conflict_pairs(t, spark):
    e = t("events").select((F.col("event_id") % 40).alias("target"), (F.col("user_id") % 6).alias("agent"), F.col("event_type").alias("action"))
    return joins.conflicts(e, "agent", "target", "action")


@query("""WITH c AS (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS cx, s_acctbal / 10 AS cy, 1.0 + s_suppkey % 3 AS r FROM supplier)
SELECT p_partkey, s_suppkey FROM part JOIN c ON (p_size - cx) * (p_size - cx) + (p_retailprice - cy) * (p_retailprice - cy) < (r + 3) * (r + 3)""")
def circle_theta(t, spark):
    k = F.col("s_suppkey")
    c = t("supplier").select("s_suppkey", (k % 50).cast("double").alias("cx"), (F.col("s_acctbal") / 10).alias("cy"), (1.0 + k % 3).alias("r"))
    return joins.in_circles(t("part"), c, "p_size", "p_retailprice", "cx", "cy", "r").select("p_partkey", "s_suppkey")


@query("SELECT a.l_orderkey AS step, a.l_linenumber AS agent, a.l_quantity - b.l_quantity AS dx, round(a.l_discount - b.l_discount, 6) AS dy FROM lineitem a JOIN (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 WHERE a.l_linenumber > 1")
def leader_offsets(t, spark):
    li = t("lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("agent"), F.lit(1).alias("leader"), "l_quantity", "l_discount")
    lead = li.groupBy("step", "agent").agg(F.count("*").alias("n"), F.first("l_quantity").alias("l_quantity"), F.first("l_discount").alias("l_discount")).where("n = 1").drop("n").withColumn("leader", F.lit(1))
    out = joins.led(li.where("agent > 1").select(*lead.columns).unionByName(lead.where("agent = 1")), "step", "agent", "leader", "l_quantity", "l_discount")
    return out.where("agent > 1").select("step", "agent", "dx", F.round("dy", 6).alias("dy"))


# Aggregates.


@query("SELECT c_mktsegment, sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*) AS mean, (SELECT sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*) FROM customer) AS overall FROM customer GROUP BY 1 HAVING mean > overall")
def group_above_avg(t, spark):
    return aggs.above_average(t("customer"), "c_mktsegment", "c_acctbal")


@query("SELECT user_id, ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")
def busy_days(t, spark):
    return aggs.busy_days(t("events"), "user_id", "ts").withColumn("day", _day("day"))


@query("SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, max(o_totalprice) AS largest, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def multi_agg(t, spark):
    return aggs.summary(t("orders"), "o_orderpriority", "o_totalprice")


@query("SELECT o_custkey, min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, date_diff('day', min(o_orderdate), max(o_orderdate))::INT AS days FROM orders GROUP BY 1")
def first_last_days(t, spark):
    d = aggs.first_to_last(t("orders"), "o_custkey", "o_orderdate")
    return d.select("o_custkey", _day("first").alias("first"), _day("last").alias("last"), "days")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) = 1")
def argmax(t, spark):
    return aggs.arg_max(t("lineitem"), "l_suppkey", "l_extendedprice", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_distinct, count(user_id)::BIGINT AS n FROM events GROUP BY 1")
def nunique(t, spark):
    return aggs.distinct_count(t("events"), "event_type", "user_id")


@query("SELECT p_type, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER () AS share FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def freq(t, spark):
    return aggs.frequencies(t("part"), "p_type")


@query("""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), top AS (SELECT l_partkey FROM c ORDER BY n DESC, l_partkey LIMIT 10)
SELECT CASE WHEN top.l_partkey IS NULL THEN 'Other' ELSE c.l_partkey::VARCHAR END AS category, sum(n)::BIGINT AS n FROM c LEFT JOIN top USING (l_partkey) GROUP BY 1""")
def topn_other(t, spark):
    return aggs.top_n_other(t("lineitem"), "l_partkey")


@query("SELECT coalesce(CASE WHEN event_id % 7 > 0 THEN event_type END, 'unknown') AS status, count(*)::BIGINT AS n FROM events GROUP BY 1")
def status_hist(t, spark):
    return aggs.histogram(t("events").withColumn("event_type", F.when(F.col("event_id") % 7 > 0, F.col("event_type"))), "event_type")


@query("SELECT conv_id, count(*)::BIGINT AS n, sum(length(role))::DOUBLE / count(role) AS avg_role, max(length(role))::INT AS max_role, sum(length(text))::DOUBLE / count(text) AS avg_text, max(length(text))::INT AS max_text FROM conversations GROUP BY 1")
def len_stats(t, spark):
    return aggs.length_stats(t("conversations"), "role", "text", ["conv_id"])


@query("SELECT count(*)::BIGINT AS total, round(100.0 * count(*) FILTER (ok = 1) / count(*), 1) AS success_rate, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*), 3) AS avg_l_quantity, round(sum(l_tax::DECIMAL(18,2))::DOUBLE / count(*), 3) AS avg_l_tax FROM (SELECT *, (l_returnflag = 'R')::INT AS ok FROM lineitem)")
def kpi(t, spark):
    return aggs.kpis(t("lineitem").withColumn("ok", (F.col("l_returnflag") == "R").cast("int")), "ok", ["l_quantity", "l_tax"])


@query("SELECT min(p_size) AS low, max(p_size) AS high FROM part")
def filter_bounds(t, spark):
    return t("part").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("SELECT event_type, round(quantile_cont(value, 0), 4) AS low, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 1), 4) AS high FROM events GROUP BY 1")
def quartiles(t, spark):
    return aggs.quartiles(t("events"), "event_type", "value")


@query("SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1")
def chunked_sum(t, spark):
    li = t("lineitem")
    return aggs.partial_then_final([li.where(F.pmod("l_orderkey", F.lit(3)) == i) for i in range(3)], "l_returnflag", "l_extendedprice")


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS successes, count(*) FILTER (l_returnflag = 'R')::BIGINT AS failures FROM lineitem GROUP BY 1")
def success_fail(t, spark):
    return aggs.success_failure(t("lineitem"), "l_suppkey", F.col("l_returnflag") != "R")


@query("SELECT event_type, count(*) FILTER (coalesce(a = 1, false))::BIGINT AS passed, count(*)::BIGINT AS total, passed / total AS rate FROM (SELECT event_type, CASE WHEN event_id % 11 > 0 THEN event_id % 2 END AS a FROM events) GROUP BY 1")
def scenario_pass_rate(t, spark):
    e = t("events").select("event_type", F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 2).alias("a"), F.lit(1).alias("e"))
    return aggs.pass_rate(e, "event_type", "a", "e")


@query("SELECT conv_id, string_agg(role, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS roles, string_agg('- ' || role, chr(10) ORDER BY turn) AS bullets FROM conversations GROUP BY 1")
def joined_text(t, spark):
    return t("conversations").groupBy("conv_id").agg(aggs.ordered_list(F.col("role"), F.col("turn"), "\n\n---\n\n").alias("roles"), aggs.bulleted(F.col("role"), F.col("turn")).alias("bullets"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::INT AS n FROM documents")
def substring_counts(t, spark):
    return t("documents").select("doc_id", aggs.occurrences(F.col("text"), "th").alias("n"))


@query("SELECT l_linenumber::VARCHAR AS agent, count(*)::BIGINT AS points, sum(l_quantity)::DOUBLE AS total FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity DESC) GROUP BY 1")
def trajectory_rebuild(t, spark):
    li = windows.latest_of_each(t("lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber")), "k", [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").desc()])
    steps = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), F.col("l_quantity")))).alias("positions"))
    return aggs.trajectories(steps, "l_orderkey", "positions").select("agent", F.size("path").cast("long").alias("points"), F.aggregate("path", F.lit(0.0), lambda a, x: a + x).alias("total"))


# Windows, order, sets.


@query("SELECT c_mktsegment, o_orderkey, o_totalprice, r AS rank FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 3")
def top3_dense(t, spark):
    j = joins.inner_on(t("orders"), t("customer"), "o_custkey", "c_custkey")
    return windows.top_ranks(j, "c_mktsegment", "o_totalprice").select("c_mktsegment", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_mktsegment, o_orderkey, o_totalprice, r AS rank FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 3")
def top3_rownum(t, spark):
    j = joins.inner_on(t("orders"), t("customer"), "o_custkey", "c_custkey")
    return windows.top_rows(j, "c_mktsegment", "o_totalprice", "o_orderkey").select("c_mktsegment", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT s_suppkey, round(100 * s_acctbal / (SELECT sum(s_acctbal::DECIMAL(18,2))::DOUBLE FROM supplier), 4) AS percent FROM supplier")
def pct_total(t, spark):
    return windows.share_of_total(t("supplier"), "s_acctbal").select("s_suppkey", "percent")


@query("SELECT s_suppkey, round(100 * s_acctbal / sum(s_acctbal::DECIMAL(18,2)) OVER (PARTITION BY s_nationkey)::DOUBLE, 4) AS percent FROM supplier")
def pct_group(t, spark):
    return windows.share_of_group(t("supplier"), "s_nationkey", "s_acctbal").select("s_suppkey", "percent")


@query("SELECT p_partkey, sum(p_retailprice::DECIMAL(18,2)) OVER (PARTITION BY p_brand)::DOUBLE / count(*) OVER (PARTITION BY p_brand) AS encoded FROM part")
def target_enc(t, spark):
    return windows.target_encoded(t("part"), "p_brand", "p_retailprice").select("p_partkey", "encoded")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) / count(*) OVER () AS encoded FROM part")
def freq_enc(t, spark):
    return windows.frequency_encoded(t("part"), "p_brand").select("p_partkey", "encoded")


@query(f"SELECT day::VARCHAR AS day, last_value(total IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM ({_SPINE})")
def ffill(t, spark):
    return windows.filled_forward(_spine(t), "total", "day").select(_day("day").alias("day"), "total")


@query(f"SELECT day::VARCHAR AS day, first_value(total IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS total FROM ({_SPINE})")
def bfill(t, spark):
    return windows.filled_backward(_spine(t), "total", "day").select(_day("day").alias("day"), "total")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM ({_SPINE})), n AS (SELECT *, CASE WHEN total IS NOT NULL THEN i END AS pos FROM s),
w AS (SELECT *, last_value(total IGNORE NULLS) OVER a AS v0, last_value(pos IGNORE NULLS) OVER a AS i0, first_value(total IGNORE NULLS) OVER b AS v1, first_value(pos IGNORE NULLS) OVER b AS i1 FROM n WINDOW a AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT day::VARCHAR AS day, round(CASE WHEN total IS NOT NULL THEN total WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 4) AS total FROM w""")
def interp(t, spark):
    return windows.interpolated(_spine(t), "total", "day").select(_day("day").alias("day"), F.round("total", 4).alias("total"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::INT AS session_id FROM conversations")
def session_seq(t, spark):
    return windows.numbered(t("conversations"), "conv_id", [F.col("turn"), F.col("role")]).select("conv_id", "turn", "session_id")


@query("SELECT conv_id, count(*)::BIGINT AS n, CASE WHEN length(arg_min(text, turn)) > 50 THEN substr(arg_min(text, turn), 1, 50) || '...' ELSE arg_min(text, turn) END AS preview FROM conversations GROUP BY 1")
def group_preview(t, spark):
    return windows.group_preview(t("conversations"), "conv_id", "text", "turn")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(t, spark):
    return windows.latest_of_each(t("events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def last50(t, spark):
    return windows.newest_of_each(t("events"), "event_type", [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def capped_log(t, spark):
    return windows.newest(t("events"), [F.col("ts").desc(), F.col("event_id")]).select("event_id", "event_type")


@query("SELECT month(o_orderdate)::INT AS month, count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1")
def concat_months(t, spark):
    o = t("orders")
    months = [o.where(F.month("o_orderdate") == m).withColumn("month", F.lit(m)) for m in range(1, 13)]
    return sets.concat(months).groupBy("month").agg(F.count("*").alias("n"), aggs.exact_sum("o_totalprice").alias("total"))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def mixed_concat(t, spark):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.concat([c, t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))], missing=True)


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders")
def ordered_split(t, spark):
    return sets.ordered_split(t("orders"), "o_orderkey").select("o_orderkey", "split")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i % 100 = 0")
def nth_rows(t, spark):
    return sets.every_nth(t("part"), "p_partkey", 100).select("p_partkey")


@query("SELECT p_partkey, (['easy', 'medium', 'hard'])[1 + ('0x' || left(md5(p_partkey::VARCHAR), 8))::BIGINT % 3] AS level FROM part")
def sampled_category(t, spark):
    return t("part").select("p_partkey", sets.category(F.col("p_partkey"), ["easy", "medium", "hard"]).alias("level"))


# Scalars.


@query("SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS money, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, left(sha256(o_orderkey || chr(31) || o_orderstatus), 24) AS id FROM orders")
def formatted_orders(t, spark):
    o = t("orders")
    return o.select("o_orderkey", scalars.money(F.col("o_totalprice")).alias("money"), scalars.iso_time(F.col("o_orderdate")).alias("at"), scalars.stable_id(F.col("o_orderkey"), F.col("o_orderstatus"), length=24).alias("id"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * l_discount + l_tax * l_tax, 8) AS sq FROM lineitem")
def sum_of_squares(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.squares(F.col("l_discount"), F.col("l_tax")), 8).alias("sq"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS label, event_id % 3 AS third, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def labelled_counts(t, spark):
    e = t("events").withColumn("label", F.when(F.col("event_type") == "error", "bad").otherwise("good"))
    return e.groupBy("label", (F.col("event_id") % 3).alias("third")).agg(F.count("*").alias("n"))
