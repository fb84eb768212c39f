"""Scans over whole tables without a task for all rows: fills, interpolation, exact quartiles."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggs, nested, windows


def filled(df, how, **more):
    return [r.x for r in how(df, "x", "k", **more).orderBy("k").collect()]


CASES = {
    "gaps longer than a range": [(k, float(k) if k % 97 == 5 else None) for k in range(600)],
    "none at either end": [(k, float(k * k) if 100 <= k < 500 and k % 3 else None) for k in range(600)],
    "nothing": [(k, None) for k in range(50)],
    "one row": [(7, 1.5)],
    "all there": [(k, -float(k)) for k in range(40)],
    "far apart": [(k**3, float(k) if k % 5 else None) for k in range(300)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("parts", [1, 5])
def test_fills(spark, case, parts, monkeypatch):
    rows = CASES[case]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as there can be, empty ones too
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "k long, x double").repartition(parts)
        p = pd.Series([x for _, x in rows], dtype=float)
        plain = lambda s: [None if v != v else v for v in s]
        assert filled(df, windows.filled_forward) == plain(p.ffill())
        assert filled(df, windows.filled_backward) == plain(p.bfill())
        got = filled(df, windows.interpolated)
        want = plain(p.interpolate(method="linear", limit_direction="forward"))
        assert [g is None for g in got] == [w is None for w in want] and all(abs(g - w) < 1e-9 for g, w in zip(got, want) if g is not None)
        assert windows.filled_forward(df.withColumn("_extra", F.lit(1)), "x", "k", name="y").columns == ["k", "x", "_extra", "y"]
        assert filled(df, windows.interpolated) == filled(df.withColumn("g", F.lit(1)), windows.interpolated, by=["g"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_fill_of_equal_places(spark):
    """Rows of equal order stay in one range; each gets a value of its own place or an earlier one."""
    df = spark.createDataFrame([(k // 4, float(k // 4) if k % 4 == 0 and k % 8 else None) for k in range(200)], "k long, x double")
    got = windows.filled_forward(df, "x", "k", name="y").where("k > 1").collect()
    assert len(got) == 192 and all(r.y in (r.k, r.k - 1, r.k - 2) for r in got)


def test_no_window_without_partition(spark):
    df = spark.createDataFrame(CASES["one row"], "k long, x double")
    for how in (windows.filled_forward, windows.filled_backward, windows.interpolated):
        plan = how(df, "x", "k")._jdf.queryExecution().optimizedPlan().toString()
        lines = [x for x in plan.splitlines() if "windowspecdefinition(" in x]
        assert lines and all("windowspecdefinition(_range" in x or "windowspecdefinition(_all" in x for x in lines)


def test_quartiles(spark):
    r = np.random.default_rng(2)
    groups = {"normal": r.normal(size=60_000), "ties": r.integers(0, 5, 30_000).astype(float), "same": np.full(25_000, 3.5), "long tail": np.exp(r.normal(size=30_000) * 4), "few": np.array([4.0, 1.0, 2.0]), "one": np.array([9.0]), None: np.arange(10.0)}
    frame = pd.concat([pd.DataFrame({"g": [g] * len(v), "x": v}) for g, v in groups.items()])
    df = spark.createDataFrame(frame, "g string, x double").unionByName(spark.createDataFrame([("few", None), ("empty", None)], "g string, x double"))
    for small in (10**5, 0):
        aggs.SMALL, kept = small, aggs.SMALL
        got = {row.g: tuple(row)[1:] for row in aggs.quartiles(df, "g", "x").collect()}
        aggs.SMALL = kept
        assert set(got) == set(groups)
        for g, v in groups.items():
            assert np.allclose(got[g], np.quantile(v, (0, 0.25, 0.5, 0.75, 1)), atol=1e-4, rtol=1e-6), g
    assert aggs.quartiles(df.limit(0), "g", "x").count() == 0


def node(parent, children, role="user", text="x"):
    return (parent, children, ((role,), ([text],)))


def plain_pairs(tree):
    """The question-answer pairs of one export tree."""
    says = lambda k: (tree[k][2][0][0], tree[k][2][1][0][0]) if k in tree else (None, "")
    at, path = next((k for k, n in tree.items() if n[0] == nested.ROOT), None), []
    if at is None:
        path = list(tree)
    while at is not None and at in tree and at not in path:
        path.append(at)
        at = (tree[at][1] or [None])[0]
    out = []
    for k in path:
        good = [says(c)[1] for c in tree[k][1] or [] if says(c)[0] == "assistant" and says(c)[1].strip()]
        if says(k)[0] == "user" and says(k)[1].strip() and good:
            out.append((says(k)[1], good[0]))
    return [(*x, i) for i, x in enumerate(out)]


def test_tree_walks(spark):
    """Random trees: branches, cycles, children that are missing, no root, blank texts, no children."""
    r = np.random.default_rng(8)
    trees = {}
    for t in range(200):
        n = int(r.integers(1, 30))
        kids = lambda i: None if r.random() < 0.05 else [f"n{r.integers(0, n + 2)}" if r.random() < 0.2 else f"n{i + 1 + j}" for j in range(r.integers(0, 3))]  # noqa: B023, E731
        trees[f"t{t}"] = {f"n{i}": node(nested.ROOT if i in (0, 5) and t % 4 else f"n{i - 1}", kids(i), ("user", "assistant", "system")[r.integers(0, 3)], ("", " ", f"said {i}", f"more {i}")[r.integers(0, 4)]) for i in range(n)}
    keyed = lambda n: {"parent": n[0], "children": n[1], "message": {"author": {"role": n[2][0][0]}, "content": {"parts": n[2][1][0]}}}
    texts = [json.dumps({"id": t, "mapping": m and {k: keyed(n) for k, n in m.items()}}) for t, m in [*trees.items(), ("none", {}), ("null", None)]]
    df = spark.createDataFrame([(t,) for t in texts], "j string").select(F.from_json("j", f"id string, mapping {nested.TREE}").alias("x")).select("x.*")  # maps in their order
    got = {}
    for x in nested.question_answers(df, keep_rootless_id=True).collect():
        got.setdefault(x.conversation_id, []).append((x.instruction, x.output, x.session_id))
    want = {t: plain_pairs(m) for t, m in trees.items()}
    assert {t: sorted(v, key=lambda x: x[2]) for t, v in got.items()} == {t: v for t, v in want.items() if v} and len(got) > 15


def test_a_walk_of_many_nodes(spark):
    n = 20_000
    tree = {f"n{i}": node(nested.ROOT if not i else f"n{i - 1}", [f"n{i + 1}"] if i + 1 < n else [], ("user", "assistant")[i % 2], f"said {i}") for i in range(n)}
    df = spark.createDataFrame([("long", tree)], f"id string, mapping {nested.TREE}")
    got = nested.question_answers(df).orderBy("session_id").collect()
    assert [(x.instruction, x.output, x.session_id) for x in got] == [(f"said {i}", f"said {i + 1}", i // 2) for i in range(0, n, 2)]
