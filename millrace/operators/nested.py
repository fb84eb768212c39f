"""Restructuring of conversations: export trees, role maps, tool calls, templates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import filled_template  # noqa: F401  (part of this surface)
from millrace.sources.shared import dropped, written

NODE = "struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"
TREE = f"map<string,{NODE}>"
ROOT = "client-created-root"


def node_text(node: Column) -> Column:
    return F.coalesce(F.array_join(node["message"]["content"]["parts"], " "), F.lit(""))


def node_role(node: Column) -> Column:
    return F.coalesce(node["message"]["author"]["role"], F.lit("unknown"))


def tree_nodes(df: DataFrame, mapping: str = "mapping", id_: str = "id") -> DataFrame:
    """A row for each node of each row's tree, written: (tree, id, at, key, parent, role, text, children); at is its place in the map."""
    trees = df.select(F.monotonically_increasing_id().alias("tree"), F.col(id_).alias("id"), F.col(mapping).alias("m"))
    rows = trees.select("tree", "id", F.posexplode("m").alias("at", "key", "node"))
    n = F.col("node")
    return written(rows.select("tree", "id", "at", "key", n["parent"].alias("parent"), node_role(n).alias("role"), node_text(n).alias("text"), n["children"].alias("children")), "tree-nodes")


def tree_roots(nodes: DataFrame) -> DataFrame:
    """(tree, key) of the first node whose parent is the client's root; no row for trees without one."""
    return nodes.where(F.col("parent") == ROOT).groupBy("tree").agg(F.min_by("key", "at").alias("key"))


def walked(nodes: DataFrame) -> DataFrame:
    """(tree, key, place): the nodes from the root along first children, each once; a missing child or a node met before ends the walk.

    By pointers that double: a round reaches twice as far along every walk, so the longest decides by its logarithm, and a
    tree's nodes are never in one row or task."""
    reached = written(tree_roots(nodes).withColumn("place", F.lit(0).cast("long")), "tree-walk")
    there = nodes.select("tree", F.col("key").alias("next"))
    jump = nodes.select("tree", "key", F.get("children", F.lit(0)).alias("next")).join(reached.select("tree"), "tree", "left_semi").join(there, ["tree", "next"], "left_semi")
    n, step, jump = reached.count(), 1, written(jump.select("tree", "key", "next"), "tree-jumps")
    while True:
        on = reached.join(jump, ["tree", "key"]).select("tree", F.col("next").alias("key"), (F.col("place") + step).alias("place"))
        old, reached = reached, written(reached.union(on).groupBy("tree", "key").agg(F.min("place").alias("place")), "tree-walk")
        dropped(old)
        if (m := reached.count()) == n:
            return reached
        n, step = m, 2 * step
        far = jump.select("tree", F.col("key").alias("next"), F.col("next").alias("far"))
        old, jump = jump, written(jump.join(far, ["tree", "next"]).select("tree", "key", F.col("far").alias("next")), "tree-jumps")
        dropped(old)


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "") == ""


def question_answers(df: DataFrame, mapping: str = "mapping", id_: str = "id", keep_rootless_id: bool = False) -> DataFrame:
    """(instruction, output, conversation_id, session_id): each non-blank user node with its first non-blank assistant child.

    Rooted conversations are walked along first children; others give all their user nodes, under the id 'unknown'."""
    nodes = tree_nodes(df, mapping, id_)
    path = walked(nodes)
    rooted = nodes.join(path, ["tree", "key"]).withColumn("rooted", F.lit(True))
    others = nodes.join(path.select("tree").distinct(), "tree", "left_anti").withColumn("place", F.col("at").cast("long")).withColumn("rooted", F.lit(False))
    said = rooted.unionByName(others).where((F.col("role") == "user") & ~_blank(F.col("text")))
    asked = said.select("tree", "id", "rooted", "place", F.col("text").alias("instruction"), F.posexplode("children").alias("nth", "key"))
    answers = nodes.where((F.col("role") == "assistant") & ~_blank(F.col("text"))).select("tree", "key", F.col("text").alias("output"))
    first = F.min(F.struct("nth", "output", "instruction", "id", "rooted")).alias("x")
    pairs = asked.join(answers, ["tree", "key"]).groupBy("tree", "place").agg(first).select("tree", "place", "x.*")
    given = F.coalesce(F.col("id"), F.lit("unknown"))
    cid = given if keep_rootless_id else F.when(F.col("rooted"), given).otherwise(F.lit("unknown"))
    number = F.row_number().over(W.partitionBy("tree").orderBy("place")) - 1
    return pairs.select("instruction", "output", cid.alias("conversation_id"), number.alias("session_id"))


def adjacent_answers(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Flat turns: each user turn that an assistant turn follows, numbered from 0 within its conversation."""
    w = W.partitionBy(conv).orderBy(turn)
    t = turns.withColumns({"_role": F.lead("role").over(w), "_text": F.lead("text").over(w)})
    p = t.where("role = 'user' and _role = 'assistant'")
    return p.select(F.col("text").alias("instruction"), F.col("_text").alias("output"), F.col(conv).alias("conversation_id"), (F.row_number().over(w) - 1).alias("session_id"))


#: Source roles and theirs in the chat format; fixed values.
ROLES = {"human": "user", "gpt": "assistant"}


def mapped_role(c: Column, roles: dict[str, str] = ROLES) -> Column:
    out = c
    for a, b in roles.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string>"


def tool_messages(conversations: Column, key: Column) -> Column:
    """Messages array<struct<from,value>> as chat messages with tool calls before their responses.

    Calls and responses wait until the next answer (or the end), calls first; a response belongs to the latest waiting call,
    one without any is dropped, as are calls that aren't JSON objects. Ids are hashes of key and position."""
    none = F.lit(None)

    def message(role: str, content: Column, calls: Column = none, call_id: Column = none) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), calls.cast(f"array<{CALL}>").alias("tool_calls"), call_id.cast("string").alias("tool_call_id")).cast(MESSAGE)

    state = f"struct<done:array<{MESSAGE}>,calls:array<{CALL}>,replies:array<{MESSAGE}>,n:int>"
    no_calls, no_messages = F.array().cast(f"array<{CALL}>"), F.array().cast(f"array<{MESSAGE}>")

    def made(done: Column, calls: Column, replies: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), calls.alias("calls"), replies.alias("replies"), n.cast("int").alias("n")).cast(state)

    def flushed(a: Column) -> Column:
        calls = F.when(F.size(a["calls"]) > 0, F.array(message("assistant", F.lit(""), a["calls"]))).otherwise(no_messages)
        return F.concat(a["done"], calls, a["replies"])

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        name = F.coalesce(F.get_json_object(x["value"], "$.name"), F.lit(""))
        args = F.coalesce(F.get_json_object(x["value"], "$.arguments"), F.lit("{}"))
        cid = F.concat(F.lit("call_"), F.substring(F.sha2(F.concat_ws(":", key.cast("string"), n.cast("string")), 256), 1, 24))
        call = F.struct(cid.alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), args.alias("arguments")).alias("function")).cast(CALL)
        sound = F.coalesce(F.schema_of_variant(F.try_parse_json(x["value"])).startswith("OBJECT"), F.lit(False))
        latest = F.try_element_at(a["calls"], F.lit(-1))
        return (
            F.when(x["from"] == "human", made(F.concat(a["done"], F.array(message("user", x["value"]))), a["calls"], a["replies"], n))
            .when(x["from"] == "gpt", made(F.concat(flushed(a), F.array(message("assistant", x["value"]))), no_calls, no_messages, n))
            .when((x["from"] == "function_call") & sound, made(a["done"], F.concat(a["calls"], F.array(call)), a["replies"], n))
            .when((x["from"] == "observation") & latest.isNotNull(), made(a["done"], a["calls"], F.concat(a["replies"], F.array(message("tool", x["value"], none, latest["id"]))), n))
            .otherwise(made(a["done"], a["calls"], a["replies"], n))
        )

    return F.aggregate(conversations, made(no_messages, no_calls, no_messages, F.lit(0)), step, flushed)


def _envelopes(text: str | None) -> str:
    try:
        tools = json.loads(text) if text and text.strip() else []
    except ValueError:
        tools = []
    out = []
    for t in tools if isinstance(tools, list) else []:
        if not isinstance(t, dict):
            continue
        if isinstance(t.get("function"), dict):
            out.append({**t, "type": t.get("type", "function")})
        elif "name" in t:
            body = {"name": t["name"], "description": t.get("description", ""), "parameters": t.get("parameters", {"type": "object", "properties": {}})}
            out.append({"type": "function", "function": body})
    return json.dumps(out, ensure_ascii=False)


def _all_envelopes(tools: pd.Series) -> pd.Series:
    return tools.map(_envelopes)


def tool_envelopes(tools: Column) -> Column:
    """Tool lists of any shape as one JSON list of function envelopes; '[]' for what isn't a list. Stays text: shapes differ by row."""
    return F.pandas_udf(_all_envelopes, "string")(tools)


def rendered(messages: Column) -> Column:
    """<|im_start|>role, content, <|im_end|> for each message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))), "")


def well_formed(messages: Column) -> Column:
    """Each tool message comes behind one with tool calls, and an answer with calls isn't the last without its responses."""
    calls = F.transform(messages, lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
    return ~F.exists(F.transform(messages, lambda m, i: (m["role"] == "tool") & ~F.exists(F.slice(calls, F.lit(1), F.greatest(i, F.lit(0))), lambda c: c)), lambda bad: bad)


def tag_counts(text: Column, tags: list[str]) -> Column:
    import re

    return F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[F.regexp_count(text, F.lit(re.escape(t))) for t in tags]))


def flattened(df: DataFrame, column: str) -> DataFrame:
    """One row a struct of an array column; null and empty arrays give none."""
    return df.select(F.explode(column).alias("_x")).select("_x.*")
