"""Concatenation, sampling and splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concat(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    """UNION ALL by name; missing columns become null if that is allowed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def row_numbers(df: DataFrame, order: str, name: str = "_row", parts: int = 64) -> DataFrame:
    """Numbers from 0 in a total order, without one task for all rows: ranges are numbered apart and shifted.

    order must be unique; the range of a row is its value's place among approximate percentiles."""
    cuts = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("c"))
    cut = df.crossJoin(cuts).withColumn("_range", F.size(F.filter("c", lambda x: x < F.col(order)))).drop("c")
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = cut.withColumn("_in", F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1)
    return out.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_r", "_in", "_before")


def ordered_split(df: DataFrame, order: str, test: float = 0.2) -> DataFrame:
    """df with split: the last ceil(test * n) rows in the order are 'test', the others 'train'."""
    numbered = row_numbers(df, order)
    n = df.agg(F.count("*").alias("_all"))
    limit = F.col("_all") - F.ceil(F.col("_all") * F.lit(test))
    return numbered.crossJoin(n).withColumn("split", F.when(F.col("_row") >= limit, "test").otherwise("train")).drop("_row", "_all")


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    return row_numbers(df, order).where(F.pmod("_row", F.lit(n)) == 0).drop("_row")


def category(key: Column, values: list[str]) -> Column:
    """A category that the key fixes, evenly spread: by the first 32 bits of the MD5 of its text, which other engines have too."""
    drawn = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (drawn % len(values) + 1).cast("int"))


def zipped(*arrays: str) -> Column:
    """Parallel arrays as an array of structs."""
    return F.arrays_zip(*arrays)


def few_shot(df: DataFrame, examples: str, question: str) -> Column:
    """A prompt of worked examples and a question, from two columns."""
    return F.concat_ws("\n\n\n", examples, question)
