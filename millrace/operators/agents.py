"""Scores, auctions, conflicts, games and verdicts over agent records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import winner_and_runner_up


def utility(confidence: Column, cost: Column, eta_minutes: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> Column:
    return alpha * confidence - beta * cost - gamma * eta_minutes / 60.0


def penalty(successes: Column, failures: Column) -> Column:
    """min(1, twice the share of failures); 0 without a record."""
    n = F.coalesce(successes, F.lit(0)) + F.coalesce(failures, F.lit(0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.coalesce(failures, F.lit(0)) / n))


def adjusted(confidence: Column, successes: Column, failures: Column) -> Column:
    return confidence * (1 - penalty(successes, failures))


def auction(bids: DataFrame, reputation: DataFrame, task: str = "task", agent: str = "agent_id", seq: str = "seq", **weights: float) -> DataFrame:
    """(task, agent, utility, place): the winner and the runner-up of each task by utility with adjusted confidence; earlier bids first."""
    r = reputation.select(F.col(agent).alias("_a"), "successes", "failures")
    b = bids.where(F.col("confidence").isNotNull()).join(r, F.col(agent) == F.col("_a"), "left")
    u = utility(adjusted(F.col("confidence"), F.col("successes"), F.col("failures")), F.col("cost"), F.col("eta_minutes"), **weights)
    return winner_and_runner_up(b.withColumn("utility", F.round(u, 6)), task, "utility", seq).select(task, agent, "utility", "place")


def recorded(reputation: DataFrame, outcomes: DataFrame, agent: str = "agent_id") -> DataFrame:
    """Reputation counts with new outcomes (agent_id, ok) added."""
    new = outcomes.groupBy(agent).agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
    return reputation.select(agent, "successes", "failures").unionByName(new).groupBy(agent).agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))


def priority(kind: Column, levels: dict[str, int]) -> Column:
    """A level by name, 0 for others."""
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def yielding(agent_a: Column, priority_a: Column, agent_b: Column, priority_b: Column) -> Column:
    """Who gives way: the one of lower priority, b of equals."""
    return F.when(priority_b <= priority_a, agent_b).otherwise(agent_a)


def pure_equilibria(payoffs: DataFrame) -> DataFrame:
    """Rows (p1, p2, u1, u2) from which no player gains by leaving alone."""
    a = payoffs.alias("a")
    better1 = payoffs.select(F.col("p2").alias("_p"), F.col("u1").alias("_u")).groupBy("_p").agg(F.max("_u").alias("_m"))
    better2 = payoffs.select(F.col("p1").alias("_q"), F.col("u2").alias("_v")).groupBy("_q").agg(F.max("_v").alias("_n"))
    return a.join(better1, (F.col("p2") == F.col("_p")) & (F.col("u1") == F.col("_m"))).join(better2, (F.col("p1") == F.col("_q")) & (F.col("u2") == F.col("_n"))).select("p1", "p2", "u1", "u2")


def verdict(min_clearance: Column, final_error: Column, least_clearance: float = 3.0, most_error: float = 2.0) -> Column:
    return (min_clearance >= least_clearance) & (final_error <= most_error)
