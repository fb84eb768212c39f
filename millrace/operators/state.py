"""Keyed state as tables: last write wins, expiry on read, versions, capped logs, backoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import latest_of_each, newest


def put(table: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """The table after writes, one row a key: the last by seq, new ones over old."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_of_each(both, key, [F.col("_new").desc(), F.col(seq).desc()]).drop("_new")


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def age(ts: Column, now: Column) -> Column:
    return now - ts


def fresh(ts: Column, ttl: Column, now: Column) -> Column:
    """Younger than its time to live; an equal age is stale."""
    return F.coalesce(age(ts, now) < ttl, F.lit(False))


def read_fresh(table: DataFrame, ts: str, ttl: str, now: float) -> DataFrame:
    return table.where(fresh(F.col(ts), F.col(ttl), F.lit(now)))


def healthy(ts: Column, timeout: Column, now: Column) -> Column:
    """Heard of within timeout, inclusive; never heard of is unhealthy."""
    return F.coalesce(age(ts, now) <= timeout, F.lit(False))


def optimistic(table: DataFrame, updates: DataFrame, key: str, now: float) -> tuple[DataFrame, DataFrame]:
    """(applied, refused) of updates (key, expected_version, status): a missing or stale key is 'missing', another version a 'conflict';
    applied rows get the next version and keep their timestamp."""
    t = table.select(F.col(key).alias("_k"), F.col("version").alias("_v"), F.col("timestamp").alias("_ts"), F.col("ttl_seconds").alias("_ttl"))
    j = updates.join(t, F.col(key) == F.col("_k"), "left")
    alive = fresh(F.col("_ts"), F.col("_ttl"), F.lit(now))
    problem = F.when(~alive, "missing").when(F.col("_v") != F.col("expected_version"), "conflict")
    j = j.withColumn("problem", problem)
    done = j.where("problem is null").select(key, "status", (F.col("_v") + 1).alias("version"), F.col("_ts").alias("timestamp"), F.col("_ttl").alias("ttl_seconds"))
    return done, j.where("problem is not null").select(key, "expected_version", "status", "problem")


def versioned(writes: DataFrame, key: str, order: str, ttl: float) -> DataFrame:
    """Create-or-update in order, folded for each key: version 1 for a new or stale key, else the next version.

    An update keeps the first timestamp of its run, so expiry counts from the creation."""
    run = "struct<version:int,ts:double,status:string>"
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ts").cast("double").alias("ts"), F.col("status").alias("status"))))

    def step(a: Column, x: Column) -> Column:
        alive = F.coalesce(x["ts"] - a["ts"] < ttl, F.lit(False))
        return F.when(alive, F.struct((a["version"] + 1).alias("version"), a["ts"].alias("ts"), x["status"].alias("status")).cast(run)).otherwise(F.struct(F.lit(1).alias("version"), x["ts"].alias("ts"), x["status"].alias("status")).cast(run))

    start = F.struct(F.lit(0).alias("version"), F.lit(None).cast("double").alias("ts"), F.lit(None).cast("string").alias("status")).cast(run)
    return writes.groupBy(key).agg(F.aggregate(rows, start, step).alias("s")).select(key, "s.version", "s.ts", "s.status")


def capped_log(log: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    return newest(log, order, n)


def backoff(failures: Column, base: float = 2.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.when(failures <= 0, F.lit(0.0)).otherwise(F.least(base * F.pow(F.lit(factor), failures - 1), F.lit(most)))


def backoff_table(spark, n: int = 10, base: float = 2.0, factor: float = 2.0, most: float = 60.0) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("attempt"), backoff(F.col("id"), base, factor, most).alias("wait"))


def propagated(events: DataFrame, statuses: DataFrame, rules: dict[str, str], key: str = "shipment_id") -> DataFrame:
    """(key, event_type, old_status, new_status, notice): events joined to the status that they change."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    e = events.withColumn("new_status", F.try_element_at(table, F.col("event_type"))).where("new_status is not null")
    out = e.join(statuses.select(key, F.col("status").alias("old_status")), key, "left")
    return out.select(key, "event_type", "old_status", "new_status", F.concat(F.col(key).cast("string"), F.lit(": "), F.coalesce("old_status", F.lit("unknown")), F.lit(" -> "), F.col("new_status")).alias("notice"))
