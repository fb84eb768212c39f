"""Operators on literal examples with known results."""

import datetime as dt
import hashlib
import json
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import chunk, json_text, metrics, scalars, subword, text
from millrace.operators import agents, aggs, clean, joins, nested, sets, sim, state, vectors, windows


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


# Cleaning.


def test_sparse_columns(spark):
    rows = [(i, None if i < 40 else 1.0, None if i < 30 else 1.0, float("nan") if i < 35 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    assert {r.column_name: r.ratio for r in clean.missing_ratios(df).collect()} == {"a": 0.0, "b": 0.4, "c": 0.3, "d": 0.35}
    assert clean.drop_sparse(df).columns == ["a", "c"]


def test_cleaning_expressions(spark):
    assert col(spark, ["25", "30yrs", "28years", "35 yrs", "40", None, "forty"], clean.leading_digits) == [25, 30, 28, 35, 40, None, None]
    assert col(spark, ["50,000", "$60,000", "70000", "$1,20,000", None], clean.currency) == [50000, 60000, 70000, 120000, None]
    day = dt.date(2023, 1, 1)
    assert col(spark, ["2023-01-01", "01/01/2023", "January 1, 2023", "1 Jan 2023", "2023.01.01", "no"], clean.mixed_date) == [day] * 5 + [None]
    ages = [5, 17, 25, 35, 45, 60, 75, 90, 0, 101, None]
    assert col(spark, ages, clean.binned, "int") == ["Child", "Teen", "Adult", "Middle Aged", "Middle Aged", "Senior", "Elderly", "Elderly", None, None, None]
    assert col(spark, ["abc", "abcdefg", None], lambda c: clean.preview(c, 5)) == ["abc", "abcde...", None]
    assert col(spark, ["Pune, MH", "Delhi", None], lambda c: F.struct(*clean.split_two(c))) == [("Pune", "MH"), ("Delhi", None), (None, None)]
    assert col(spark, [" a ", " \n\t", "", None], clean.not_blank) == [True, False, False, False]
    assert col(spark, ["a", "z", None], lambda c: clean.keep_or_other(c, ["a"])) == ["a", "Other", "Other"]
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 3)]
    assert col(spark, days, clean.weekend_label, "date") == ["Weekday", "Weekend", "Weekend", "Weekday"]


def test_dedupe_search_split(spark):
    df = spark.createDataFrame([(1, "HR", 3), (1, "HR", 1), (2, "IT", 2), (None, None, 4), (None, None, 5)], "k int, d string, seq int")
    assert sorted(r.seq for r in clean.first_of_each(df, ["k", "d"], [F.col("seq")]).collect()) == [1, 2, 4]
    assert clean.repeated_keys(df, ["k", "d"]).first().n == 2 and clean.repeated_keys(df.limit(0), ["k"]).first().n == 0
    assert clean.search(df, "h.", ["d"]).count() == 2 and clean.search(df, "h.", ["d"], literal=True).count() == 0
    assert clean.where_equal(df, "d", "All").count() == 5
    logs = spark.createDataFrame([('{"step": 3}',), ('{"step": "end"}',), ("{}",)], "raw string")
    a, b = clean.split_log(logs)
    assert [r.step for r in a.collect()] == [3] and b.count() == 2


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(f(lit(x))) for f, x in ((scalars.number, 1234567.0), (scalars.percent, 0.256), (scalars.money, -1234.5), (scalars.milliseconds, 0.25), (scalars.seconds, 1.25))] == ["1,234,567", "25.6%", "-$1,234.50", "250 ms", "1.2s"]
    assert one(scalars.half_up(lit(0.125))) == 0.13 and one(scalars.half_even(lit(0.125))) == 0.12
    assert one(scalars.iso_time(lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"
    assert one(scalars.stable_id(lit(1), lit("a"))) == one(scalars.stable_id(lit(1), lit("a"))) != one(scalars.stable_id(lit(1), lit("b")))


# Joins.


def test_join_checks(spark):
    emp = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "emp_id int, dept_id int")
    pay = spark.createDataFrame([(10, 100), (10, 200), (20, 300)], "dept_id int, salary int")
    assert emp.join(pay, "dept_id").count() == 5 and joins.averaged_join(emp, pay, "dept_id", "salary").count() == 3
    r = joins.fan_out(emp, pay, "dept_id").first()
    assert tuple(r) == (3, 3, 5, 1)
    with pytest.raises(joins.CardinalityError):
        joins.checked(emp, pay, "dept_id")
    assert joins.checked(pay, emp.select("dept_id").distinct(), "dept_id").count() == 3
    a = spark.createDataFrame([(1, 5, 6)], "k int, salary int, bonus int")
    b = spark.createDataFrame([(1, 7, "x")], "k int, salary int, dept string")
    assert joins.suffixed(a, b, "k", ("_prev", "_curr")).columns == ["k", "salary_prev", "bonus", "salary_curr", "dept"]
    assert joins.keep_left(a, b, "k").first().salary == 5
    n = spark.createDataFrame([(None, 1)], "k int, v int")
    assert joins.inner(n, n.withColumnRenamed("v", "w"), "k").count() == 0 and joins.inner(n, n.withColumnRenamed("v", "w"), "k", True).count() == 1


def test_spine_and_fills(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([(d(1), 100.0), (d(2), 150.0), (d(5), 200.0), (d(7), 180.0)], "day date, v double")
    full = joins.on_spine(df, "day")
    get = lambda f: [None if r.v is None else round(r.v, 2) for r in f(full, "v", "day").orderBy("day").collect()]
    assert get(windows.interpolated) == [100, 150, 166.67, 183.33, 200, 190, 180]
    assert get(windows.filled_forward) == [100, 150, 150, 150, 200, 200, 180]
    assert get(windows.filled_backward) == [100, 150, 200, 200, 200, 180, 180]


def test_circles_equal_the_plain_join(spark):
    r = np.random.default_rng(1)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-30, 30, (200, 2)))], "i int, x double, y double")
    c = spark.createDataFrame([(i, float(x), float(y), float(k)) for i, (x, y, k) in enumerate(r.uniform(-30, 30, (20, 3)) % [60, 60, 5])], "j int, cx double, cy double, r double")
    got = {(a.i, a.j) for a in joins.in_circles(p, c, "x", "y", "cx", "cy", "r").collect()}
    want = {(a.i, b.j) for a in p.collect() for b in c.collect() if math.dist((a.x, a.y), (b.cx, b.cy)) < b.r + 3}
    assert got == want


# Aggregates, windows, sets.


def test_aggregates(spark):
    pay = spark.createDataFrame([("HR", 50000), ("HR", 62000), ("IT", 90000), ("IT", 100000), ("Fin", 70000), ("Fin", 80000)], "dept string, salary int")
    assert [r.dept for r in aggs.above_average(pay, "dept", "salary").collect()] == ["IT"]
    months = spark.createDataFrame([("Mumbai", "Jan", 100, 0), ("Mumbai", "Feb", 150, 1), ("Delhi", "Jan", 200, 2), ("Delhi", "Mar", 220, 3), ("Delhi", "Apr", 220, 4)], "c string, m string, s int, o int")
    assert {r.c: r.m for r in aggs.arg_max(months, "c", "s", [F.col("o")]).collect()} == {"Mumbai": "Feb", "Delhi": "Mar"}
    empty = spark.createDataFrame([], "ok int, a double")
    assert tuple(aggs.kpis(empty, "ok", ["a"]).first()) == (0, 0.0, 0.0)
    some = spark.createDataFrame([(1, 1.0), (0, 2.0), (1, 4.0)], "ok int, a double")
    assert tuple(aggs.kpis(some, "ok", ["a"]).first()) == (3, 66.7, 2.333)
    assert col(spark, ["a.b.a", "", None], lambda c: aggs.occurrences(c, ".")) == [2, 0, None]
    steps = spark.createDataFrame([(1, {"a": [1.0, 2.0]}), (0, {"a": [0.0, 0.0], "b": [5.0, 5.0]})], "s int, p map<string,array<double>>")
    assert {r.agent: r.path for r in aggs.trajectories(steps, "s", "p").collect()} == {"a": [[0.0, 0.0], [1.0, 2.0]], "b": [[5.0, 5.0]]}
    top = spark.createDataFrame([(x,) for x in "aaabbcd"], "x string")
    assert {r.category: r.n for r in aggs.top_n_other(top, "x", 2).collect()} == {"a": 3, "b": 2, "Other": 2}


def test_shares_and_splits(spark):
    p = spark.createDataFrame([("a", "x", 20), ("b", "x", 35), ("c", "y", 15), ("d", "y", 30)], "p string, c string, s int")
    by = lambda d: {r.p: r.percent for r in d.collect()}
    assert by(windows.share_of_total(p, "s")) == {"a": 20, "b": 35, "c": 15, "d": 30}
    assert by(windows.share_of_group(p, "c", "s")) == {"a": 36.3636, "b": 63.6364, "c": 33.3333, "d": 66.6667}
    n = spark.range(103).repartition(7)
    got = {r.id: r.split for r in sets.ordered_split(n, "id").collect()}
    assert [got[i] for i in range(103)] == ["train"] * 82 + ["test"] * 21
    assert sorted(r.id for r in sets.every_nth(n, "id", 50).collect()) == [0, 50, 100]


# Text.


def test_tokenizers(spark):
    s = "Hello, world! It's 2024."
    assert col(spark, [s], text.words_and_marks)[0] == ["Hello", ",", "world", "!", "It", "'", "s", "2024", "."]
    assert col(spark, [s], text.alphanumeric)[0] == []
    assert col(spark, ["one two3 four."], text.alphanumeric)[0] == ["one", "two3"]
    assert col(spark, ["é"], text.utf8_bytes)[0] == [195, 169] and col(spark, [""], text.utf8_bytes)[0] == []
    assert col(spark, ["a b--c"], text.without_blanks)[0] == ["a", "b", "--", "c"]
    assert col(spark, ["😀a"], text.characters)[0] == ["😀", "a"]
    assert col(spark, ["a b c", "a"], lambda c: text.ngrams(text.by_space(c), 2)) == [["a b", "b c"], []]
    assert col(spark, ["Ann: hi there\nnoise\nBob: yes"], text.speaker_turns)[0] == [(0, "Ann", "hi there"), (1, "Bob", "yes")]
    assert col(spark, ["One. Two! three? Four"], text.sentences)[0] == ["One.", "Two! three?", "Four"]
    assert col(spark, ["v"], lambda c: text.filled_template("a <<x>> b <<x>>", {"x": c}))[0] == "a v b v"


def test_subwords(spark):
    merges = subword.learnt_bpe(spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "word string, n long"), 10)
    assert merges[0] == ("e", "s") and merges[1] == ("es", "t")
    ranks = {p: i for i, p in enumerate(merges)}
    assert "".join(subword.bpe_symbols("lowest", ranks)) == "lowest" + subword.END
    vocab = {"play", "##ing", "run", "foot", "ball"}
    assert [subword.wordpiece(w, subword.wordpiece_tries(vocab)) for w in ("playing", "runner", "football")] == [["play", "##ing"], ["[UNK]"], ["foot", "##ball"]]
    df = spark.createDataFrame([(["#", "##hg", "##hf"],)], "t array<string>")
    assert df.select(subword.wordpiece_text(F.col("t"))).first()[0] == "#hghf"
    assert subword.longest_match("player", subword.Trie({"play", "er"})) == ["play", "er"] and subword.longest_match("xplay", subword.Trie({"play"})) == ["x", "play"]
    assert col(spark, ["low low"], subword.bpe_encoder(merges))[0] == subword.bpe_symbols("low", ranks) * 2


def recounted(forms):
    """(symbols, pairs) counted from scratch over (form, weight)."""
    single, pairs = Counter(), Counter()
    for form, n in forms:
        for t in form:
            single[t] += n
        for p in zip(form, form[1:]):
            pairs[p] += n
    return single, pairs


def spelled_anew(form, pair):
    out = []
    for t in form:
        if out and not isinstance(out[-1], list) and (out[-1], t) == pair:
            out[-1] = ["".join(pair)]  # a list: it may not join again in this round
        else:
            out.append(t)
    return tuple(t[0] if isinstance(t, list) else t for t in out)


def plain_bpe(words, merges):
    forms, out = [((*w, subword.END), n) for w, n in words.items()], []
    for _ in range(merges):
        pairs = recounted(forms)[1]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        forms = [(spelled_anew(f, best), n) for f, n in forms]
    return out


def plain_wordpiece(words, size):
    forms, vocab = [(tuple(w), 1) for w in words], set("".join(words))
    while len(vocab) < size:
        single, pairs = recounted(forms)
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p] / (single[p[0]] * single[p[1]]), p))
        vocab.add("".join(best))
        forms = [(spelled_anew(f, best), n) for f, n in forms]
    return vocab


def by_slices(word, vocab, later=""):
    """Longest pieces by trying each length: later ones with their ## first, then bare; None where one is missing."""
    out, at = [], 0
    while at < len(word):
        to = next((t for t in range(len(word), at, -1) if (at and later and later + word[at:t] in vocab) or word[at:t] in vocab), None)
        if to is None:
            return None
        out.append((later if at else "") + word[at:to])
        at = to
    return out


def test_tries_find_what_slices_find():
    r = np.random.default_rng(11)
    text = lambda most: "".join(r.choice(list("ab#é"), r.integers(1, most)))
    for _ in range(300):
        vocab = {text(5) for _ in range(12)} | {"##" + text(4) for _ in range(4)}
        word = text(14)
        assert subword.wordpiece(word, subword.wordpiece_tries(vocab)) == (by_slices(word, vocab, "##") or [subword.UNKNOWN])
        all_ = vocab | set(word)
        assert subword.longest_match(word, subword.Trie(vocab)) == by_slices(word, all_)


def test_subwords_learn_from_all_words(spark):
    from millrace.queries import texts

    r = np.random.default_rng(6)
    words = {"".join(r.choice(list("aab$\\.*é"), r.integers(1, 6))): int(r.integers(1, 9)) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for shard in (1 << 20, 50):  # a shard for each partition, or many
        subword.SHARD, kept = shard, subword.SHARD
        assert subword.learnt_bpe(df, 45) == plain_bpe(words, 45)  # past a writing of the shards
        assert subword.learnt_wordpiece(df, 30) == plain_wordpiece(words, 30)
        subword.SHARD = kept
    assert subword.learnt_bpe(df.limit(0), 5) == [] and subword.learnt_wordpiece(df.limit(0), 5) == set()
    assert subword.learnt_bpe(df.limit(2), 500) == plain_bpe({r.word: r.n for r in df.limit(2).collect()}, 500)  # until no pair is left
    # A rare word of characters that no other word has, behind 600 frequent ones.
    common = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"[:24])
    docs = spark.createDataFrame([(1, common), (2, common), (3, "日7")], "doc_id long, text string")
    got = texts.wordpiece_encode(lambda name: docs, spark).where("doc_id = 3").first()
    assert got.tokens != hashlib.md5(subword.UNKNOWN.encode()).hexdigest()


def plain_chunks(paras, most, least):
    n = lambda s: len(s.split())
    out, cur, size = [], [], 0
    for p in paras:
        if size + n(p) <= most:
            cur, size = cur + [p], size + n(p)
        else:
            out.append(" ".join(cur))
            cur, size = [p], n(p)
    out += [" ".join(cur)] if cur else []
    merged = out[:1]
    for c in out[1:]:
        if n(c) < least and n(merged[-1]) + n(c) <= most:
            merged[-1] += " " + c
        else:
            merged.append(c)
    return merged


def test_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    got = docs.select("text", chunk.chunks(F.col("text"), 200, 20).alias("c")).collect()
    for r in got:
        paras = [p.strip() for p in r.text.split("\n\n") if p.strip()]
        if all(len(p.split()) <= 200 for p in paras):
            assert r.c == plain_chunks(paras, 200, 20)
        assert " ".join(r.c).split() == r.text.split()
    long_ = "Aa bb cc. " + "Dd " * 25 + "ee. Ff gg."
    assert [len(x.split()) for x in col(spark, [long_], lambda c: chunk.split_oversized(c, 10))[0]] == [3, 10, 10, 6, 2]
    with pytest.raises(ValueError):
        chunk.chunks(F.lit(""), overlap=5)


def test_topics_keep_whole_lines(spark):
    from millrace.queries import texts

    lines = [f"{'long ' * 20}line {i} ends" for i in range(12)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[0])], "doc_id long, text string")
    got = texts.chunk_topics(lambda name: df, spark).orderBy("doc_id", "chunk").collect()
    for d, own in ((1, lines), (2, lines[:1])):
        said = " ".join(" ".join(r.content for r in got if r.doc_id == d).split())
        assert said == " ".join(own)


def test_conflicts_of_all_events(spark):
    from millrace.queries import relational

    rows = [(1, 0, "a"), (900_040, 0, "x"), (1_000_040, 1, "y")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    assert [tuple(r) for r in relational.conflict_pairs(lambda name: df, spark).select("target", "agent_a", "action_a", "agent_b", "action_b").collect()] == [(0, 0, "x", 1, "y")]


def test_markdown(spark):
    md = "lead\n\n# One\n\npara a\nb\n\n- item\n\n```\ncode\n```\n\n## Two\n\nword word word\n\n# Three\n\nw " + "x " * 8
    got = col(spark, [md], lambda c: chunk.markdown_sections(c))[0]
    assert [tuple(s) for s in got][:3] == [("Untitled", "lead"), ("One", "para a\nb"), ("Two", "word word word")]
    merged = col(spark, [md], lambda c: chunk.merge_short_sections(chunk.markdown_sections(c), 5))[0]
    assert [s.title for s in merged] == ["Untitled | Three"] and merged[0].content.startswith("lead\n\npara a")
    split = spark.createDataFrame([([("T", "a b c\n\nd e f\n\n")],)], "s array<struct<title:string,content:string>>").select(chunk.split_long_sections(F.col("s"), 4)).first()[0]
    assert [tuple(s) for s in split] == [("T (part 1)", "a b c"), ("T (part 2)", "d e f")]
    sub = spark.createDataFrame([([("T", "intro x\n## S\nbody y z")],)], "s array<struct<title:string,content:string>>").select(chunk.split_long_sections(F.col("s"), 3)).first()[0]
    assert [tuple(s) for s in sub] == [("T", "intro x"), ("T > S", "body y z")]
    assert chunk.recursive_pieces("aa bb\n\ncc dd ee", 6) == ["aa bb", "cc dd", "ee"]


def test_json_text(spark):
    cases = ['{"a":1}', '```json\n{"a":1}\n```', "```\n{\"a\":1}\n```", 'Sure: {"a":1} ok', '{"a":1}{"b":2}', 'x {"a":{"b":2}} y', "nothing", None]
    got = col(spark, cases, json_text.embedded_json)
    assert [g and json.loads(g) for g in got] == [{"a": 1}] * 5 + [{"a": {"b": 2}}, None, None]
    assert json.loads(col(spark, ["no"], json_text.greedy_json)[0]) == {"error": "no JSON object"}
    assert col(spark, ["[1,2]", "x"], json_text.int_list) == [[1, 2], None]
    schemas = {"shipment:": "status string", "evt-": "event_type string"}
    df = spark.createDataFrame([("shipment:1", '{"status":"ok"}'), ("evt-1", '{"event_type":"e"}')], "k string, v string")
    assert [r.x for r in df.select(json_text.by_prefix(F.col("k"), F.col("v"), schemas).alias("x")).collect()] == ['{"status":"ok"}', '{"event_type":"e"}']


def test_rouge():
    assert metrics.ngram_f1("a b c".split(), "a b d".split(), 1) == pytest.approx(2 / 3) and metrics.lcs_f1("a x b".split(), "a b".split()) == pytest.approx(0.8)
    assert metrics.tokens("Running dogs, quickly!") == ["runn", "dog", "quick"]


# Conversations.


def tree(spark, convs):
    rows = [json.dumps({"id": i, "mapping": m}) for i, m in convs]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    return df.select(F.from_json("j", f"id string, mapping {nested.TREE}").alias("x")).select("x.*")


def node(parent, children, role=None, *parts):
    return {"parent": parent, "children": children, "message": role and {"author": {"role": role}, "content": {"parts": list(parts)}}}


def test_export_trees(spark):
    rooted = {"r": node(nested.ROOT, ["u"]), "u": node("r", ["b", "a", "gone"], "user", "q", "1"), "b": node("u", ["u2"], "assistant", " "), "a": node("u", [], "assistant", "yes"), "u2": node("b", ["u3"], "user", "  "), "u3": node("u2", ["a3"], "user", "q2"), "a3": node("u3", ["r"], "assistant", "ok"), "off": node("x", ["a"], "user", "unseen")}
    rootless = {"u": node(None, ["a"], "user", "hi"), "a": node("u", [], "assistant", "there")}
    got = sorted(tuple(r) for r in nested.question_answers(tree(spark, [("c1", rooted), ("c2", rootless), ("c3", {})])).collect())
    assert got == [("hi", "there", "unknown", 0), ("q 1", "yes", "c1", 0), ("q2", "ok", "c1", 1)]
    assert nested.question_answers(tree(spark, [("c2", rootless)]), keep_rootless_id=True).first().conversation_id == "c2"


def test_tool_calls(spark):
    m = [("human", "q"), ("observation", "orphan"), ("function_call", '{"name":"f","arguments":{"a":1}}'), ("function_call", "broken"), ("observation", "r"), ("gpt", "done"), ("function_call", '{"name":"g"}')]
    df = spark.createDataFrame([(1, m)], "k int, m array<struct<`from`:string,value:string>>")
    out = df.select(nested.tool_messages(F.col("m"), F.col("k")).alias("x")).first().x
    assert [x.role for x in out] == ["user", "assistant", "tool", "assistant", "assistant"]
    call = out[1].tool_calls[0]
    assert call.function.name == "f" and json.loads(call.function.arguments) == {"a": 1} and out[2].tool_call_id == call.id and out[2].content == "r"
    assert out[4].tool_calls[0].function.arguments == "{}"
    tools = ["", "[]", "bad", '{"a":1}', '[{"name":"f"},{"function":{"name":"g"}},3]', None]
    got = [json.loads(x) for x in col(spark, tools, nested.tool_envelopes)]
    assert got[:4] == [[]] * 4 and got[5] == [] and [t["type"] for t in got[4]] == ["function"] * 2 and got[4][0]["function"]["description"] == ""


# Vectors.


def test_vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(20, 70))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    for row in df.select("vec_id", F.hex(vectors.packed_bytes(F.col("embedding"))).alias("h"), vectors.normalised(F.col("embedding")).alias("n")).collect():
        assert row.h == np.packbits(x[row.vec_id] > 0).tobytes().hex().upper()
        assert np.allclose(row.n, x[row.vec_id] / np.linalg.norm(x[row.vec_id]))
    top = vectors.hamming_top(df, df.where("vec_id = 3"), 4).orderBy("rank").collect()
    d = [int(((x[3] > 0) != (x[i] > 0)).sum()) for i in range(20)]
    assert [(t.distance, t.vec_id) for t in top] == sorted((d[i], i) for i in range(20))[:4] and top[0].score == 1.0
    assert spark.range(1).select(vectors.prompt(F.lit("q"), F.lit(None).cast("string"))).first()[0].startswith("Context:\nNo context available for query: q")
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalised(F.col("v"))).first()[0]
    assert zero == [0.0, 0.0]


# Agents, state, simulation.


def test_scores(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(agents.utility(lit(0.9), lit(10.0), lit(60.0))) == pytest.approx(0.9 - 10 - 1)
    assert [one(agents.penalty(lit(a), lit(b))) for a, b in ((0, 0), (5, 0), (0, 4), (2, 1))] == pytest.approx([0, 0, 1, 2 / 3])
    assert one(agents.adjusted(lit(0.8), lit(0), lit(0))) == 0.8 and one(agents.adjusted(lit(0.9), lit(0), lit(3))) == 0.0
    bids = spark.createDataFrame([("t", "cheap", 0.9, 0.1, 1.0, 1), ("t", "dear", 0.9, 0.8, 1.0, 0), ("t", "none", None, 0.0, 0.0, 2)], "task string, agent_id string, confidence double, cost double, eta_minutes double, seq int")
    none = spark.createDataFrame([], "agent_id string, successes long, failures long")
    win = lambda r: [x.agent_id for x in agents.auction(bids, r).orderBy("place").collect()]
    assert win(none) == ["cheap", "dear"]
    assert win(spark.createDataFrame([("cheap", 0, 5)], none.schema)) == ["dear", "cheap"]
    assert [one(state.backoff(lit(n))) for n in (0, 1, 2, 3, 10)] == [0, 2, 4, 8, 60]
    got = agents.pure_equilibria(spark.createDataFrame([("Push", "Push", 0, 0), ("Push", "Yield", 3, 1), ("Yield", "Push", 1, 3), ("Yield", "Yield", 2, 2)], "p1 string, p2 string, u1 int, u2 int"))
    assert sorted((r.p1, r.p2) for r in got.collect()) == [("Push", "Yield"), ("Yield", "Push")]


def test_keyed_state(spark):
    t = spark.createDataFrame([("a", 1, 100.0, 10), ("b", 2, 50.0, 10)], "k string, version int, timestamp double, ttl_seconds int")
    u = spark.createDataFrame([("a", 1, "x"), ("a", 9, "x"), ("b", 2, "x"), ("c", 1, "x")], "k string, expected_version int, status string")
    done, refused = state.optimistic(t, u, "k", 105.0)
    assert [(r.k, r.version, r.timestamp) for r in done.collect()] == [("a", 2, 100.0)]
    assert sorted((r.k, r.problem) for r in refused.collect()) == [("a", "conflict"), ("b", "missing"), ("c", "missing")]
    assert [r.k for r in state.read_fresh(t, "timestamp", "ttl_seconds", 110.0).collect()] == []
    w = spark.createDataFrame([("a", 1, 0.0, "n"), ("a", 2, 5.0, "m"), ("a", 3, 10.0, "p")], "k string, o int, ts double, status string")
    assert tuple(state.versioned(w, "k", "o", 10.0).first()) == ("a", 1, 10.0, "p") and tuple(state.versioned(w, "k", "o", 11.0).first()) == ("a", 3, 0.0, "p")


def test_swarm(spark):
    for kind, n in (("line", 4), ("v_shape", 5), ("grid", 6)):
        got = [(r.dx, r.dy) for r in sim.formation(spark, kind, n, 10.0).orderBy("i").collect()]
        assert np.allclose(got, sim._offsets(kind, n, 10.0))
    run = spark.createDataFrame([("r", "grid", 5, 10.0, 160, 0.1, [(20.0, 40.0, 3.5)])], "run string, formation string, drones int, spacing double, steps int, dt double, obstacles array<struct<x:double,y:double,radius:double>>")
    steps = sim.simulated(run)
    m = sim.swarm_metrics(steps).first()
    assert steps.count() == 800 and m.min_clearance > 0 and m.max_deviation >= m.final_error >= 0
    assert steps.where("step = 159 and agent = 'Drone_A'").first().y == pytest.approx(10 + 160 * 0.25)


def test_pair_totals_of_a_large_group(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 2, None), ("a", 3, 9), ("a", 3, None), ("a", None, 4), ("b", 1, 3), ("c", 1, None), ("c", 2, 7), (None, 1, 2), (None, 2, 2), ("d", 1, 2), ("d", 1, 4), ("e", 4, 6), ("e", 2, 6)]
    df = spark.createDataFrame(rows, "g string, k long, v int")
    made = joins.unordered_pairs(df, "g", "k", ["v"]).groupBy("g").agg(F.count("*").alias("pairs"), F.sum(F.abs(F.col("v_i") - F.col("v_j"))).alias("spread"))
    got = joins.pair_totals(df, "g", "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect())) and got.dtypes == made.dtypes
    # 2e10 pairs, which no test's time would make.
    n = 200_000
    big = spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("v"))
    assert [tuple(r) for r in joins.pair_totals(big, "g", "k", "v").collect()] == [("x", n * (n - 1) // 2, n * n // 4)]


def test_bytes_of_a_long_text(spark):
    s = "\x00a\né\U0001f600ÿ\r\x85 "
    assert col(spark, [s, None], text.utf8_bytes) == [list(s.encode()), []]
    df = spark.range(1).select(F.repeat(F.lit("aé\n"), 500_000).alias("s")).select(text.utf8_bytes(F.col("s")).alias("b"))
    began = time.monotonic()
    assert df.select(F.size("b"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x)).collect() == [(2_000_000, 500_000 * (97 + 195 + 169 + 10))]
    assert time.monotonic() - began < 60  # a walk from the start for each byte takes hours


def test_counts_in_bounded_tasks(spark, monkeypatch):
    """As many tasks as the bytes of the texts ask for, with the counts of one plain grouping."""
    monkeypatch.setattr(text, "TASK_BYTES", 100)
    texts = ["a b a b", None, "", "a b a b", *[f"w{i} a b w{i % 7}" for i in range(300)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    grams = lambda t: zip(t.split(), t.split()[1:])
    got = text.counted(df, lambda c: text.ngrams(text.by_space(c), 2), "gram")
    assert dict(map(tuple, got.collect())) == Counter(" ".join(g) for t in texts if t for g in grams(t))
    assert got.rdd.getNumPartitions() == -(-sum(len(t or "") for t in texts) // 100)
    assert text.counted(df.limit(0), text.by_space, "w").count() == 0
