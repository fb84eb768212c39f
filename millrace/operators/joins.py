"""Joins with the checks and column rules of data frames. The optimiser chooses the strategy; nothing is broadcast here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join key repeats where it must not."""


def inner(a: DataFrame, b: DataFrame, key: str, null_matches: bool = False) -> DataFrame:
    """Equi-join on a common key, kept once; null_matches joins null keys with each other."""
    if not null_matches:
        return a.join(b, key, "inner")
    other = b.withColumnRenamed(key, "_key")
    return a.join(other, a[key].eqNullSafe(other["_key"])).drop("_key")


def inner_on(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Equi-join on keys of different names; the right key goes."""
    return a.join(b, a[left] == b[right]).drop(b[right])


def fan_out(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(left_rows, right_rows, joined_rows, right_repeated): what a join on key would make, without making it."""
    n, m = a.groupBy(key).agg(F.count("*").alias("n")), b.groupBy(key).agg(F.count("*").alias("m"))
    total = n.join(m, key, "full").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("joined_rows"),
        F.count_if(F.col("m") > 1).alias("right_repeated"),
    )
    return total


def averaged_join(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """b is averaged to one row a key first, so the join can't multiply rows."""
    mean = b.groupBy(key).agg((F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / F.count(value)).alias(f"avg_{value}"))
    return a.join(mean, key)


def checked(a: DataFrame, b: DataFrame, key: str, how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join that raises CardinalityError if a side that must be unique isn't."""
    sides = {"one_to_one": (a, b), "many_to_one": (b,), "one_to_many": (a,), "many_to_many": ()}[validate]
    for side in sides:
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise CardinalityError(f"{key} repeats, but the join is {validate}")
    return a.join(b, key, how)


def suffixed(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """A join on key with suffixes on the columns that both sides have."""
    both = [c for c in a.columns if c in b.columns and c != key]
    return a.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(b.withColumnsRenamed({c: c + suffixes[1] for c in both}), key, how)


def keep_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A join on key that keeps the left one of columns that both sides have."""
    return a.join(b.drop(*[c for c in b.columns if c in a.columns and c != key]), key)


def looked_up(df: DataFrame, table: DataFrame, column: str, key: str, value: str, name: str) -> DataFrame:
    """df with name = table's value for column; null where there is none. table must be unique on key."""
    t = table.select(F.col(key).alias("_key"), F.col(value).alias(name))
    return df.join(t, df[column] == t["_key"], "left").drop("_key")


def with_global(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df with one row of aggregates over all of it (one row: the cross join broadcasts a scalar)."""
    return df.crossJoin(df.agg(*aggregates))


def unordered_pairs(df: DataFrame, group: str, by: str, carry: list[str]) -> DataFrame:
    """Pairs i < j of the rows of each group: columns with suffixes _i and _j."""
    a = df.select(group, *[F.col(c).alias(f"{c}_i") for c in [by, *carry]])
    b = df.select(F.col(group).alias("_g"), *[F.col(c).alias(f"{c}_j") for c in [by, *carry]])
    return a.join(b, (a[group] == b["_g"]) & (a[f"{by}_i"] < b[f"{by}_j"])).drop("_g")


def pair_totals(df: DataFrame, group: str, by: str, value: str) -> DataFrame:
    """(group, pairs, spread): how many pairs unordered_pairs() makes of each group, and the sum of the distances of their whole-number
    values, without making them. A pair without a value on both sides counts, and adds nothing; groups without pairs go.

    In the order of values, each is as far from those before it as it is above their mean; a distance has no side, so which of
    the two comes first by `by` doesn't matter. Pairs of rows of equal `by` are the same sums within these, and are taken off."""
    rows = df.where(F.col(group).isNotNull() & F.col(by).isNotNull()).groupBy(group, by, value).agg(F.count("*").alias("_n"))

    def sums(rows: DataFrame, *keys: str) -> DataFrame:
        before = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        there, v, n = F.col(value).isNotNull(), F.col(value).cast("long"), F.col("_n")
        many = F.coalesce(F.sum(n).over(before), F.lit(0))
        known = F.coalesce(F.sum(F.when(there, n)).over(before), F.lit(0))
        total = F.coalesce(F.sum(v * n).over(before), F.lit(0))
        # n (n - 1) / 2 pairs of the value with itself add none to the spread, but make it 0 where it would be null.
        same = F.expr("_n * (_n - 1) div 2")
        each = rows.select(*keys, (n * many + same).alias("_pairs"), F.when(there, n * known + same).alias("_both"), F.when(there, n * (v * known - total)).alias("_far"))
        return each.groupBy(*keys).agg(F.sum("_pairs").alias("_pairs"), F.coalesce(F.sum("_both"), F.lit(0)).alias("_both"), F.coalesce(F.sum("_far"), F.lit(0)).alias("_far"))

    every = sums(rows.groupBy(group, value).agg(F.sum("_n").alias("_n")), group)
    # Only rows of a `by` that repeats in its group.
    again = rows.groupBy(group, by).agg(F.sum("_n").alias("_m")).where("_m > 1").drop("_m")
    equal = sums(rows.join(again, [group, by], "left_semi"), group, by).groupBy(group).agg(*[(-F.sum(c)).alias(c) for c in ("_pairs", "_both", "_far")])
    out = every.unionByName(equal).groupBy(group).agg(*[F.sum(c).alias(c) for c in ("_pairs", "_both", "_far")])
    return out.where("_pairs > 0").select(group, F.col("_pairs").alias("pairs"), F.when(F.col("_both") > 0, F.col("_far")).alias("spread"))


def led(df: DataFrame, step: str, agent: str, leader: str, x: str, y: str) -> DataFrame:
    """Each follower with its leader's position at the same step: dx, dy are the offsets."""
    b = df.select(F.col(step).alias("_s"), F.col(agent).alias("_a"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    out = df.join(b, (df[step] == b["_s"]) & (df[leader] == b["_a"]))
    return out.select(*df.columns, (F.col(x) - F.col("_x")).alias("dx"), (F.col(y) - F.col("_y")).alias("dy"))


def conflicts(df: DataFrame, agent: str, target: str, action: str) -> DataFrame:
    """Pairs of agents with the same target and another action: (target, agent_a, agent_b, action_a, action_b), a < b."""
    a = df.select(F.col(target).alias("target"), F.col(agent).alias("agent_a"), F.col(action).alias("action_a")).distinct()
    b = df.select(F.col(target).alias("_t"), F.col(agent).alias("agent_b"), F.col(action).alias("action_b")).distinct()
    on = (F.col("target") == F.col("_t")) & (F.col("action_a") != F.col("action_b")) & (F.col("agent_a") < F.col("agent_b"))
    return a.join(b, on).drop("_t")


def in_circles(points: DataFrame, circles: DataFrame, x: str, y: str, cx: str, cy: str, radius: str, margin: float = 3.0) -> DataFrame:
    """Points nearer to a circle's centre than its radius and a margin: an equi-join on grid cells, then the exact test.

    Cells are as wide as the largest reach, so a point meets a circle in its own or a neighbouring cell."""
    cell = circles.agg(F.max(F.col(radius) + margin).alias("_cell"))
    p = points.crossJoin(cell).withColumns({"_gx": F.floor(F.col(x) / F.col("_cell")), "_gy": F.floor(F.col(y) / F.col("_cell"))}).drop("_cell")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    c = circles.crossJoin(cell).withColumns({"_hx": F.floor(F.col(cx) / F.col("_cell")), "_hy": F.floor(F.col(cy) / F.col("_cell"))}).drop("_cell")
    c = c.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({"_hx": F.col("_hx") + F.col("_dx"), "_hy": F.col("_hy") + F.col("_dy")})
    hit = p.join(c, (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy")))
    dx, dy, reach = F.col(x) - F.col(cx), F.col(y) - F.col(cy), F.col(radius) + margin
    return hit.where(dx * dx + dy * dy < reach * reach).drop("_gx", "_gy", "_hx", "_hy", "_dx", "_dy")


def date_spine(df: DataFrame, day: str, start=None, end=None) -> DataFrame:
    """(day) for each day from the first to the last."""
    bounds = df.agg(F.coalesce(F.lit(start).cast("date"), F.min(day)).alias("a"), F.coalesce(F.lit(end).cast("date"), F.max(day)).alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))


def on_spine(df: DataFrame, day: str) -> DataFrame:
    """df with a row for each day; values are null on the days that were missing."""
    return date_spine(df, day).join(df, day, "left")
