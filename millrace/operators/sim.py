"""Swarm runs: formation layouts as expressions, one simulation a group, metrics as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plus(a: Column, b: Column) -> Column:
    return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))


def minus(a: Column, b: Column) -> Column:
    return F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y"))


def times(a: Column, k: Column) -> Column:
    return F.struct((a["x"] * k).alias("x"), (a["y"] * k).alias("y"))


def length(a: Column) -> Column:
    return F.hypot(a["x"], a["y"])


def unit(a: Column) -> Column:
    n = length(a)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.when(n <= 1e-9, zero).otherwise(times(a, 1 / n))


def clamped(a: Column, most: float) -> Column:
    return F.when(length(a) > most, times(unit(a), F.lit(most))).otherwise(a)


def formation(spark: SparkSession, kind: str, drones: int, spacing: float) -> DataFrame:
    """(agent, i, dx, dy): each follower's offset from the leader, in a line, a V or a grid behind it."""
    i = F.col("id")
    if kind == "line":
        dx, dy = F.lit(0.0), -i * spacing
    elif kind == "v_shape":
        rank = F.floor((i + 1) / 2)
        dx, dy = F.when(i % 2 == 1, 1).otherwise(-1) * rank * (spacing * 0.8), -rank * (spacing * 0.8)
    else:
        cols = max(2, math.ceil(math.sqrt(drones - 1)))
        row = F.floor((i - 1) / cols)
        dx, dy = ((i - 1) % cols - (cols - 1) / 2.0) * spacing, -(row + 1) * spacing
    name = F.concat(F.lit("Drone_"), F.chr((65 + i).cast("long")))
    return spark.range(1, drones).select(name.alias("agent"), i.cast("int").alias("i"), dx.cast("double").alias("dx"), dy.cast("double").alias("dy"))


STEPS = "run string, step int, agent string, x double, y double, error double, avoiding boolean"


def _offsets(kind: str, n: int, spacing: float) -> np.ndarray:
    k = np.arange(1, n)
    if kind == "line":
        return np.stack([0.0 * k, -k * spacing], 1)
    if kind == "v_shape":
        rank = (k + 1) // 2
        return np.stack([np.where(k % 2 == 1, 1, -1) * rank * spacing * 0.8, -rank * spacing * 0.8], 1)
    cols = max(2, math.ceil(math.sqrt(n - 1)))
    return np.stack([((k - 1) % cols - (cols - 1) / 2.0) * spacing, -((k - 1) // cols + 1.0) * spacing], 1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = math.hypot(*v)
    return v / n if n > 1e-9 else np.zeros(2)


def _run(run: str, kind: str, n: int, spacing: float, steps: int, dt: float, obstacles, speed=2.5, gain=1.4, tolerance=0.2, fastest=5.0, peer_margin=4.5) -> pd.DataFrame:
    """One run: the leader moves straight, each follower in turn steers to its place and sees those already moved."""
    place = np.vstack([[20.0, 10.0], np.array([20.0, 10.0]) + _offsets(kind, n, spacing)]) if n > 1 else np.array([[20.0, 10.0]])
    goal, speedv, out = place - place[0], np.zeros((n, 2)), []
    for step in range(steps):
        place[0] += np.array([0.0, speed]) * dt
        avoiding = [False] * n
        for i in range(1, n):
            push = np.zeros(2)
            for ox, oy, radius in obstacles:
                d = place[i] - (ox, oy)
                gap = radius + 3.0 - math.hypot(*d)
                if gap > 0:
                    avoiding[i] = True
                    u = _unit(d)
                    push += u * gap * 5.0 + np.array([-u[1], u[0]]) * 4.0
            miss = place[0] + goal[i] - place[i]
            apart = np.zeros(2)
            for j in range(n):
                d = place[i] - place[j]
                far = math.hypot(*d)
                if j != i and 1e-3 < far < peer_margin:
                    apart += _unit(d) * (peer_margin - far) * 3.0
            if math.hypot(*miss) > tolerance:
                force = push * 1.5 + miss * gain * 0.2 + apart if avoiding[i] else miss * gain + apart
            elif avoiding[i]:
                force = push
            else:
                force = None
                speedv[i] *= 0.98
            if force is not None:
                speedv[i] = speedv[i] + force * dt
                v = math.hypot(*speedv[i])
                if v > fastest:
                    speedv[i] *= fastest / v
            place[i] += speedv[i] * dt
        for i in range(n):
            error = math.hypot(*(place[0] + goal[i] - place[i])) if i else 0.0
            out.append((run, step, f"Drone_{chr(65 + i)}", place[i][0], place[i][1], error, avoiding[i]))
    return pd.DataFrame(out, columns=["run", "step", "agent", "x", "y", "error", "avoiding"])


def simulated(runs: DataFrame) -> DataFrame:
    """The step rows of each run (run, formation, drones, spacing, steps, dt, obstacles array<struct<x,y,radius>>): one row a step and agent."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        return _run(r["run"], r["formation"], int(r["drones"]), r["spacing"], int(r["steps"]), r["dt"], [(o["x"], o["y"], o["radius"]) for o in r["obstacles"]])

    return runs.groupBy("run").applyInPandas(one, STEPS)


def swarm_metrics(steps: DataFrame) -> DataFrame:
    """(run, max_deviation, final_error, min_clearance) of step rows; pairs of agents are joined by run and step."""
    errors = steps.where("agent <> 'Drone_A'").groupBy("run", "step").agg(F.round(F.avg("error"), 6).alias("e"))
    a, b = steps.select("run", "step", F.col("agent").alias("i"), "x", "y"), steps.select("run", "step", F.col("agent").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    near = a.join(b, ["run", "step"]).where("i < j").groupBy("run").agg(F.round(F.min(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))), 6).alias("min_clearance"))
    out = errors.groupBy("run").agg(F.max("e").alias("max_deviation"), F.max_by("e", "step").alias("final_error"))
    return out.join(near, "run")
