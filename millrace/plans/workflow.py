"""Workflows over DataFrames: sequence, branches, routes, loops, and the boundary of outside models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import written

Step = Callable[[DataFrame], DataFrame]


def sequence(*steps: Step) -> Step:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


def branches(key: str, **steps: Step) -> Step:
    """Independent steps over the same rows, each giving (key, a value column named as the step), joined on key.

    The rows are written first: all steps see the same ones, also where a generator made them."""

    def run(df: DataFrame) -> DataFrame:
        df = out = written(df, "branches")
        for name, s in steps.items():
            out = out.join(s(df).select(key, name), key, "left")
        return out

    return run


def routed(route: Column, **steps: Step) -> Step:
    """Each row takes the step that route names; rows without one stay as they are.

    Rows and their routes are written first, so that each row takes one route, also where a model or chance chooses it."""

    def run(df: DataFrame) -> DataFrame:
        marked = written(df.withColumn("_route", route), "routed")
        parts = [s(marked.where(F.col("_route") == name)) for name, s in steps.items()]
        rest = marked.where(F.col("_route").isNull() | ~F.col("_route").isin(*steps))
        for p in parts:
            rest = rest.unionByName(p, allowMissingColumns=True)
        return rest.drop("_route")

    return run


def each_item(df: DataFrame, key: str, items: str, work: Callable[[Column], Column], name: str = "results") -> DataFrame:
    """A worker for each item of an array, gathered in order again."""
    rows = df.select(key, F.posexplode(items).alias("_i", "_x")).withColumn("_y", work(F.col("_x")))
    got = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_y"))), lambda s: s["_y"]).alias(name))
    return df.join(got, key, "left")


def until(df: DataFrame, generate: Step, accepted: Column, rounds: int = 5) -> DataFrame:
    """Rows are generated anew until accepted, at most that often; the last try stays.

    Each round is written before it is split: what a generator gave is judged once, and no row is lost or met twice. A round
    that leaves nothing to generate is the last."""
    done, open_ = None, df
    for _ in range(rounds):
        made = generate(open_)
        tried = written(made.withColumn("_accepted", F.coalesce(accepted, F.lit(False))), "until")
        ok = tried.where("_accepted").drop("_accepted")
        done = ok if done is None else done.unionByName(ok)
        open_ = tried.where("not _accepted").drop("_accepted")
        if open_.isEmpty():
            break
    return open_ if done is None else done.unionByName(open_)


def structured(call: Callable[[str], str], schema: str, tries: int = 3):
    """A pandas UDF around call(text) -> JSON text: retried on broken JSON or errors; then null, for a fallback by coalesce."""
    fields = [f.strip().split(" ")[0].split(":")[0] for f in schema.removeprefix("struct<").removesuffix(">").split(",")]

    def once(text: str | None) -> dict | None:
        for _ in range(tries):
            try:
                got = json.loads(call(text))
                if isinstance(got, dict):
                    return {f: got.get(f) for f in fields}
            except Exception:  # a failed call is tried again, then its row is null
                continue
        return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (lambda d: None if d is None else json.dumps(d, ensure_ascii=False))(once(t)))

    return lambda c: F.from_json(run(c), schema)


def mapped(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A batched map over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield work(b)

    return df.mapInPandas(run, schema)


class Catalogue:
    """Named operations with their descriptions, as offered to an agent."""

    def __init__(self) -> None:
        self.operations: dict[str, Callable] = {}

    def register(self, f: Callable) -> Callable:
        if not f.__doc__:
            raise ValueError(f"{f.__name__} needs a description")
        self.operations[f.__name__] = f
        return f

    def described(self) -> dict[str, str]:
        return {n: (f.__doc__ or "").strip().splitlines()[0] for n, f in self.operations.items()}
