"""Connected components of a link table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def _stars(edges: DataFrame, keep) -> DataFrame:
    """For each node u, link what keep chooses of its neighbours v to the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = edges.join(least, "u")
    return linked.where(keep).select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).where("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node of its component (itself included)."""
    edges = written(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "cc-links")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = state(edges)
    while before[0]:
        both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
        large = _stars(both, F.col("v") > F.col("u"))
        edges = written(_stars(large.select(F.col("x").alias("u"), F.col("y").alias("v")), F.col("v") <= F.col("u")), "cc-round")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
