"""Spelling variants against a plain version: odd rows, hot keys, lots that end within keys, long words."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """rows of (doc_id, text)."""
    lower, count = str.maketrans(S.UPPER, S.LOWER), Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    by = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {w: min((-n[v], v) for v in vs)[1] for w, vs in by.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None)
    return out


def found(df, **more):
    rows = S.variants(df, **more).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


CHAINS = ["ringing", "singing", "sinking", "sinkings", "slinkings", "blinkings", "blinkingz", "ÉTÉété", "étéété", "naïve", "naive", "naïves", "Straße", "strase", "strasse", "aaaaaa", "aaaaa", "aaaaaaa", "aaaba", "×÷×÷×", "x" * 300, "x" * 299 + "y", "x" * 301]


def chains():
    return [(i, (w + " ") * 3 * 2 ** (k % 7)) for i, (k, w) in enumerate([(k, w) for k, w in enumerate(CHAINS)] * 2)]


def test_odd_rows(spark, docs, rows):
    more = [*chains(), (None, "Null id word words worded " * 4), (7, "twice same again " * 3), (7, "twice same again " * 3), (8, "a1b2 don't co-op x_y " * 4)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute([(r[0], r[1]) for r in rows] + more)
    assert len([1 for x in want.values() if x[0]]) > 5 and any(x[1] != x[0] and x[0] for x in want.values())
    df = df.withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("d", F.lit(1))
    assert found(df) == want
    assert found(df.repartition(7), hot=2) == want  # most keys are split
    assert S.variants(docs.limit(0)).count() == 0
    assert S.variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_lots_within_a_key(spark, monkeypatch):
    """A key's words arrive in many lots, its held ones too; postings are expanded a few at a time."""
    words = [f"{a}{b}stable" for a in "bcdfghjkl" for b in "aeiou"] + [f"stab{a}le" for a in "abcdeé"]
    rows = [(w, 3) for w in words]
    want = {(min(a, b), max(a, b)) for a in words for b in words if a != b and near(a, b)}
    table = spark.createDataFrame(rows, "word string, n long")
    sent = S.postings(table).toPandas()
    sent["part"] = 0
    sent = sent.sort_values(["key", "part", "held"], ascending=[True, True, False])
    batch = pa.RecordBatch.from_pandas(sent[["key", "part", "held", "word", "n"]], preserve_index=False)
    for lot, expanded in ((1 << 15, 1 << 21), (3, 1 << 21), (1 << 15, 16), (7, 16)):
        monkeypatch.setattr(S, "LOT", lot)
        monkeypatch.setattr(S, "EXPANDED", expanded)
        got = [p for b in S._near(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert {(min(p), max(p)) for p in got} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abß", min_size=5, max_size=9), min_size=2, max_size=40, unique=True))
def test_one_edit(words):
    """The verification, and the bound of the count filter, on all pairs."""
    g = S.Grams(pa.array(words))
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if i != j and len(words[j]) - len(words[i]) in (0, 1)]
    if not pairs:
        return
    a, b = (np.array(x) for x in zip(*pairs))
    want = [near(words[i], words[j]) for i, j in pairs]
    assert S._edited(g, a, b).tolist() == want
    enough = S._shared(g, a, b) >= g.length[b] + 2 - S.Q
    assert not any(w and not e for w, e in zip(want, enough.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=9), min_size=2, max_size=60, unique=True), st.booleans())
def test_index(words, rare):
    """Grams that repeat within words, whatever the order of the grams: no near pair is lost between the keys."""
    g = S.Grams(pa.array(words))
    order = np.bincount(g.gram, minlength=S.SYMBOLS**3) if rare else -np.arange(S.SYMBOLS**3)
    by = np.lexsort((g.place, g.gram, order[g.gram], g.row))
    nth = np.arange(len(by)) - g.at[g.row[by]]
    four, three = by[nth < 4], by[nth < 3]
    held = {}
    for x in four.tolist():
        held.setdefault((g.gram[x], g.place[x], g.length[g.row[x]]), set()).add(g.row[x])
    met = {(g.row[x], y) for x in four.tolist() for y in held.get((g.gram[x], g.place[x], g.length[g.row[x]]), ())}
    met |= {(g.row[x], y) for x in three.tolist() for p in (0, 1) for y in held.get((g.gram[x], g.place[x] + p, g.length[g.row[x]] + 1), ())}
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(b) - len(a) in (0, 1) and near(a, b)}
    assert want <= met
