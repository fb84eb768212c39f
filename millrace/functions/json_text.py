"""JSON in text: nested access, repair of model output, typed parsing by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nested(c: Column, path: str, default: str) -> Column:
    """A value of a JSON text by path, with a default; broken JSON has the default."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def parsed_or_null(c: Column, schema: str) -> Column:
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def _valid(c: Column) -> Column:
    """One JSON value and nothing behind it: the parser alone would stop after the first."""
    return F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()


def embedded_json(c: Column) -> Column:
    """The first valid JSON in a text: without code fences whole, then each shortest {...}, then the longest; null if none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    shortest = F.regexp_extract_all(c, F.lit(r"(?s)(\{.*?\})"), 1)
    longest = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    candidates = F.concat(F.array(bare), shortest, F.array(longest))
    return F.get(F.filter(candidates, lambda x: x.isNotNull() & (x.rlike(r"^\s*[\{\[]")) & _valid(x)), F.lit(0))


def greedy_json(c: Column) -> Column:
    """The longest {...} of a text if it is valid, else an error object."""
    found = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(_valid(found), found).otherwise(F.lit('{"error":"no JSON object"}'))


def int_list(c: Column) -> Column:
    """A list literal such as '[1,2]' as integers."""
    return F.from_json(c, "array<int>")


def by_prefix(key: Column, value: Column, schemas: dict[str, str]) -> Column:
    """value parsed by the schema of the key's prefix, as JSON text of that schema; the first schema that fits otherwise."""
    out = F.lit(None).cast("string")
    for schema in reversed(schemas.values()):
        parsed = F.from_json(value, schema)
        out = F.coalesce(F.when(parsed.isNotNull(), F.to_json(parsed)), out)
    for prefix, schema in schemas.items():
        out = F.when(key.startswith(prefix), F.to_json(F.from_json(value, schema))).otherwise(out)
    return out
