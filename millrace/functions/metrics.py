"""ROUGE of a text against a reference: 1- and 2-gram overlap and the longest common subsequence, as F1."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+")
#: Suffixes of the light stemmer, longest first; fixed values.
SUFFIXES = ("ingly", "edly", "ing", "ed", "es", "ly", "s")


def stemmed(word: str) -> str:
    for s in SUFFIXES:
        if len(word) > len(s) + 2 and word.endswith(s):
            return word[: -len(s)]
    return word


def tokens(text: str | None, stem: bool = True) -> list[str]:
    found = _TOKEN.findall((text or "").lower())
    return [stemmed(w) if stem and len(w) > 3 else w for w in found]


def _f1(common: int, a: int, b: int) -> float:
    return 2.0 * common / (a + b) if common else 0.0


def ngram_f1(a: list[str], b: list[str], n: int) -> float:
    x, y = Counter(zip(*(a[i:] for i in range(n)))), Counter(zip(*(b[i:] for i in range(n))))
    return _f1(sum((x & y).values()), sum(x.values()), sum(y.values()))


def lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, bit-parallel: a bit for each token of a, a few operations on whole numbers for each
    token of b. A bit is cleared where a row of the usual table grows."""
    held: dict[str, int] = {}
    for i, x in enumerate(a):
        held[x] = held.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        met = row & held.get(y, 0)
        if met:
            row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def lcs_f1(a: list[str], b: list[str]) -> float:
    return _f1(lcs(a, b), len(a), len(b))


def _rouge(made: pd.Series, reference: pd.Series) -> pd.DataFrame:
    pairs = [(tokens(a), tokens(b)) for a, b in zip(made, reference)]
    return pd.DataFrame(
        {"rouge1": [round(ngram_f1(a, b, 1), 6) for a, b in pairs], "rouge2": [round(ngram_f1(a, b, 2), 6) for a, b in pairs], "rougeL": [round(lcs_f1(a, b), 6) for a, b in pairs]}
    )


def rouge(made: Column, reference: Column) -> Column:
    """struct<rouge1,rouge2,rougeL> of a text against its reference."""
    return F.pandas_udf(_rouge, "rouge1 double, rouge2 double, rougeL double")(made, reference)
