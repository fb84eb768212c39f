"""Window functions, order and top-k. Every order ends in a total tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.shared import written


def top_ranks(df: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """Rows whose value is among the k largest different ones of its key."""
    w = W.partitionBy(key).orderBy(F.col(value).desc())
    return df.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k)


def top_rows(df: DataFrame, key: str, value: str, tie: str, k: int = 3) -> DataFrame:
    """At most k rows a key, by value, then tie."""
    w = W.partitionBy(key).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """With percent of the total; the total is a broadcast scalar, so no row moves."""
    total = df.agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("_t"))
    return df.crossJoin(total).withColumn("percent", F.round(100 * F.col(value) / F.col("_t"), 4)).drop("_t")


def _with_group(df: DataFrame, key: str, total: Column) -> DataFrame:
    """df with _t, an aggregate of its key: computed once a key and joined, so no task holds a key's rows."""
    sums = df.groupBy(F.col(key).alias("_k")).agg(total.alias("_t"))
    return df.join(sums, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def share_of_group(df: DataFrame, key: str, value: str) -> DataFrame:
    total = F.sum(F.col(value).cast("decimal(18,2)")).cast("double")
    return _with_group(df, key, total).withColumn("percent", F.round(100 * F.col(value) / F.col("_t"), 4)).drop("_t")


def target_encoded(df: DataFrame, key: str, target: str) -> DataFrame:
    mean = F.sum(F.col(target).cast("decimal(18,2)")).cast("double") / F.count(target)
    return _with_group(df, key, mean).withColumnRenamed("_t", "encoded")


def frequency_encoded(df: DataFrame, key: str) -> DataFrame:
    """The share of rows with the same key: counted once a key, then joined."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    shares = counts.crossJoin(counts.agg(F.sum("_n").alias("_all"))).select(F.col(key).alias("_k"), (F.col("_n") / F.col("_all")).alias("encoded"))
    return df.join(shares, df[key] == shares["_k"]).drop("_k")


def _carried(df: DataFrame, value: str, order: str) -> DataFrame:
    """df with _i, its place in the order from 1, and _back and _ahead, the last non-null value up to the row and the first from it on,
    each with its place. A scan without a task for all rows: ranges of the order are scanned apart, and what crosses their borders is
    carried between their summaries, a row for each range.

    Ranges come from a sampled range exchange, and are written, so that both uses see the same ones."""
    by = F.col(order).asc_nulls_first()
    cut = written(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    w = W.partitionBy("_range").orderBy(by)
    cut = cut.withColumn("_p", F.row_number().over(w).cast("long"))
    held = F.when(F.col(value).isNotNull(), F.struct("_p", F.col(value).alias("v")))
    sums = cut.groupBy("_range").agg(F.count("*").alias("_n"), F.max(held).alias("_last"), F.min(held).alias("_first")).withColumn("_all", F.col("_range") * 0)
    across = W.partitionBy("_all").orderBy("_range")
    before, behind = across.rowsBetween(W.unboundedPreceding, -1), across.rowsBetween(1, W.unboundedFollowing)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["_p"] + F.col("_base")).alias("i"), F.col(c)["v"].alias("v")))
    sums = sums.select("_range", "_base", placed("_last").alias("_last"), placed("_first").alias("_first"))
    carry = sums.withColumn("_all", F.col("_range") * 0).select(F.col("_range").alias("_r"), "_base", F.last("_last", True).over(before).alias("_from"), F.first("_first", True).over(behind).alias("_to"))
    # A row for each range: no more than there are partitions.
    d = cut.join(F.broadcast(carry), F.col("_range") == F.col("_r")).withColumn("_i", F.col("_p") + F.col("_base"))
    own = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    d = d.withColumn("_back", F.coalesce(F.last(own, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_from"))
    return d.withColumn("_ahead", F.coalesce(F.first(own, True).over(w.rowsBetween(0, W.unboundedFollowing)), "_to")).drop("_range", "_r", "_p", "_base", "_from", "_to")


_SCAN = ("_i", "_back", "_ahead")


def filled_forward(df: DataFrame, value: str, order: str, by: list[str] | None = None, name: str | None = None) -> DataFrame:
    if not by:
        return _carried(df, value, order).withColumn(name or value, F.col("_back.v")).drop(*_SCAN)
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name or value, F.last(value, ignorenulls=True).over(w))


def filled_backward(df: DataFrame, value: str, order: str, by: list[str] | None = None, name: str | None = None) -> DataFrame:
    if not by:
        return _carried(df, value, order).withColumn(name or value, F.col("_ahead.v")).drop(*_SCAN)
    w = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    return df.withColumn(name or value, F.first(value, ignorenulls=True).over(w))


def interpolated(df: DataFrame, value: str, order: str, by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Linear by row position; beyond the last value it repeats, before the first it stays null."""
    if by:
        w = W.partitionBy(*by).orderBy(order)
        d = df.withColumn("_i", F.row_number().over(w))
        own = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
        d = d.withColumns({"_back": F.last(own, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_ahead": F.first(own, True).over(w.rowsBetween(0, W.unboundedFollowing))})
    else:
        d = _carried(df, value, order)
    v0, i0, v1, i1 = (F.col(c) for c in ("_back.v", "_back.i", "_ahead.v", "_ahead.i"))
    between = v0 + (v1 - v0) * (F.col("_i") - i0) / (i1 - i0)
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(v0.isNull(), F.lit(None)).when(v1.isNull(), v0).otherwise(between)
    return d.withColumn(name or value, out).drop(*_SCAN)


def numbered(df: DataFrame, key: str, order: list[Column], name: str = "session_id") -> DataFrame:
    """Numbers from 0 within each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def group_preview(df: DataFrame, key: str, text: str, order: str, n: int = 50) -> DataFrame:
    """(key, n, preview): the first row's text of each group, cut."""
    first = F.min_by(text, order)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.when(F.length(first) > n, F.concat(F.substring(first, 1, n), F.lit("..."))).otherwise(first).alias("preview"))


def newest(df: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    """The n first rows of an order: a distributed top-n, no global sort."""
    return df.orderBy(*order).limit(n)


def newest_of_each(df: DataFrame, key: str, order: list[Column], n: int = 50) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest_of_each(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The upsert rule: one row a key, the last written."""
    return newest_of_each(df, key, order, 1)


def winner_and_runner_up(df: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """By score, the earlier of equals first; place is 1 or 2."""
    w = W.partitionBy(key).orderBy(F.col(score).desc(), F.col(seq))
    return df.withColumn("place", F.row_number().over(w)).where("place <= 2")


def capped(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
