"""Aggregations. Sums of money run in decimals, so a result doesn't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.shared import written


def exact(c: str | Column, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def exact_sum(c: str | Column, scale: int = 2) -> Column:
    return F.sum(exact(c, scale)).cast("double")


def exact_avg(c: str | Column, scale: int = 2) -> Column:
    return exact_sum(c, scale) / F.count(c if isinstance(c, str) else c)


def above_average(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, overall): groups whose mean is above that of all rows."""
    all_ = df.agg(exact_avg(value).alias("overall"))
    return df.groupBy(key).agg(exact_avg(value).alias("mean")).crossJoin(all_).where("mean > overall")


def busy_days(df: DataFrame, key: str, ts: str, more_than: int = 5) -> DataFrame:
    """(key, day, n) of the days on which a key has more rows than that."""
    return df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(exact_avg(value).alias("mean"), exact_sum(value).alias("total"), F.max(value).alias("largest"), F.count(value).alias("n"))


def partial_then_final(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sums of partial sums of several inputs; in one input Spark does the same by itself."""
    from functools import reduce

    sums = [p.groupBy(key).agg(F.sum(exact(value)).alias("_s")) for p in parts]
    return reduce(DataFrame.unionByName, sums).groupBy(key).agg(F.sum("_s").cast("double").alias("total"))


def first_to_last(df: DataFrame, key: str, day: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.datediff(F.max(day), F.min(day)).alias("days"))


def arg_max(df: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """The row with the largest value of each key; of equal ones the first in order."""
    w = W.partitionBy(key).orderBy(F.col(value).desc_nulls_last(), *order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_count(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_distinct"), F.count(value).alias("n"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share): relative frequencies of the non-null values."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def top_n_other(df: DataFrame, column: str, n: int = 10, other: str = "Other") -> DataFrame:
    """(category, n): the n most frequent values, ties by value, and the rest as other. One counting pass; n rows are ranked."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), column).limit(n).select(F.col(column).alias("_t"))
    category = F.when(F.col("_t").isNotNull(), F.col(column).cast("string")).otherwise(F.lit(other))
    return counts.join(F.broadcast(top), F.col(column) == F.col("_t"), "left").groupBy(category.alias("category")).agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias("status")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Rows, and average and largest lengths of two text columns."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        (F.sum(F.length(a)).cast("double") / F.count(a)).alias(f"avg_{a}"), F.max(F.length(a)).alias(f"max_{a}"),
        (F.sum(F.length(b)).cast("double") / F.count(b)).alias(f"avg_{b}"), F.max(F.length(b)).alias(f"max_{b}"),
    )


def kpis(df: DataFrame, ok: str, measures: list[str]) -> DataFrame:
    """One row: total, success rate in percent (1 decimal), means of the measures (3 decimals); zeros over no rows."""
    zero = F.lit(0.0)
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.round(F.try_divide(100.0 * F.count_if(F.col(ok) == 1), F.count("*")), 1), zero).alias("success_rate"),
        *[F.coalesce(F.round(F.try_divide(exact_sum(m), F.count(m)), 3), zero).alias(f"avg_{m}") for m in measures],
    )


ACCURACY = 10_000  # of the sketch: its ranks are off by n / ACCURACY at most
SMALL = 100_000  # rows that are broadcast at most


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, low, q1, median, q3, high), exact percentiles with linear interpolation; nulls take no part.

    No group is gathered: a sketch of each brackets the ranks, one more pass counts what lies below each bracket and the
    different values inside, some 8 n / ACCURACY of a group's, and those are ranked."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("x"))
    shares, margin = (0.25, 0.5, 0.75), 4 / ACCURACY
    bounds = F.array(*[F.lit(s) for q in shares for s in (max(0.0, q - margin), min(1.0, q + margin))])
    sketch = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", bounds, ACCURACY).alias("b"))
    sketch = written(sketch, "quartile-bounds")
    few = sketch.count() <= SMALL
    whole = F.col("n") <= ACCURACY  # a rank is more than the margin there
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * q).alias("at"), F.when(whole, F.col("low")).otherwise(F.col("b")[2 * i]).alias("from"), F.when(whole, F.col("high")).otherwise(F.col("b")[2 * i + 1]).alias("to")) for i, q in enumerate(shares)]))
    asked = sketch.select(F.col("k").alias("_k"), near.alias("t")).select("_k", "t.*")
    met = rows.join(F.broadcast(asked) if few else asked, F.col("k").eqNullSafe(F.col("_k")) & (F.col("x") <= F.col("to")))
    counts = met.groupBy("k", "i", "at", F.when(F.col("x") >= F.col("from"), F.col("x")).alias("v")).agg(F.count("*").alias("c"))  # null: below
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy("k", "i").orderBy(F.col("v").asc_nulls_first())))
    of = lambda rank: F.min(F.when((F.col("upto") > rank) & F.col("v").isNotNull(), F.col("v")))
    found = upto.groupBy("k", "i", "at").agg(of(F.floor("at")).alias("a"), of(F.ceil("at")).alias("z"))
    part = F.col("at") - F.floor("at")
    found = found.select("k", "i", ((1 - part) * F.col("a") + part * F.col("z")).alias("x"))
    each = found.groupBy(F.col("k").alias("_k")).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    return sketch.join(each, F.col("k").eqNullSafe(F.col("_k"))).select(F.col("k").alias(key), *[F.round(F.col(n).cast("double"), 4).alias(n) for n in ("low", "q1", "median", "q3", "high")])


def success_failure(df: DataFrame, key: str, ok: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))


def pass_rate(df: DataFrame, scenario: str, actual: str, expected: str) -> DataFrame:
    """(scenario, passed, total, rate): a missing actual value, as of failed parsing, fails."""
    ok = F.coalesce(F.col(actual) == F.col(expected), F.lit(False))
    return df.groupBy(scenario).agg(F.count_if(ok).alias("passed"), F.count("*").alias("total")).withColumn("rate", F.col("passed") / F.col("total"))


def ordered_list(value: Column, order: Column, separator: str) -> Column:
    """An aggregate: the values of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def bulleted(value: Column, order: Column) -> Column:
    return ordered_list(F.concat(F.lit("- "), value), order, "\n")


def occurrences(text: Column, part: str) -> Column:
    """How often a literal occurs in a text."""
    import re

    return F.regexp_count(text, F.lit(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", part)))


def trajectories(df: DataFrame, step: str, positions: str) -> DataFrame:
    """(agent, path): per-step position maps turned into one path an agent, in the order of steps."""
    rows = df.select(step, F.explode(positions).alias("agent", "at"))
    return rows.groupBy("agent").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col("at")))), lambda x: x["at"]).alias("path"))
