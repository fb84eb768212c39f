"""Each operator against a plain version over texts with all the odd cases, and over an empty table."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import ann, chat_format, jaccard_join, lm_scoring, mixing, quality_crf, quality_rules, suffix_dedup


def words(t):
    return (t or "").encode().split()


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append(tuple(r)[1:])
    return out


# 1


def brute_removed(texts, window=200):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = True
        edge = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), edge, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(docs, rows):
    want = defaultdict(list)
    for r, x in zip(rows, brute_removed([(r[1] or "").encode() for r in rows])):
        want[r[0]].append(x)
    assert by_id(suffix_dedup.dedup_digest(docs)) == want
    assert by_id(suffix_dedup.dedup_digest(docs, hot=2)) == want  # most anchors take the way of hot ones
    assert suffix_dedup.dedup_digest(docs.limit(0)).count() == 0
    kept = {r.doc_id: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert kept[0].text == rows[0][1] and kept[0]["kept"] == "k" and 100 not in kept and kept[400].text is None
    assert suffix_dedup.deduplicated(docs).columns == docs.columns
    assert len(kept[300].text) < len(next(r[1] for r in rows if r[0] == 300)) and kept[300].n_chars == len(kept[300].text)


def test_anchors_of_long_texts():
    buf = np.frombuffer(b" ".join(str(i * i % 977).encode() for i in range(4000)), np.uint8)
    starts = lambda got: {s: (p, h) for _, a, b, p, h, _ in zip(*(x.tolist() for x in got)) for s in range(a, b + 1)}
    offs = np.array([0, len(buf)])
    assert starts(suffix_dedup.anchors(buf, offs)) == starts(suffix_dedup.anchors(buf, offs, segment=1000))


def test_texts_longer_than_a_slice(spark):
    r = np.random.default_rng(8)
    long_ = [b" ".join(b"%x" % x for x in r.integers(0, 1 << 40, 130_000)) for _ in range(2)]  # some 1.4 MiB each
    texts = [long_[0], long_[1][:700_000] + long_[0][400_000:400_900] + long_[1][700_000:], long_[0][200_000:200_300] + b" alone"]
    assert len(texts[0]) > suffix_dedup.SLICE
    want = {i: x for i, x in enumerate(brute_removed(texts))}
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_digest(df).collect()} == want


CLASHES = ["_kept", "_nth", "_id", "_new", "_of", "_sha", "kept", "base_failed", "_doc", "_key", "_row", "size", "_size", "_block", "shards", "copies", "_copy", "_shard", "target", "_text", "node", "sha", "h", "_w"]


def test_clashing_columns(spark, rows):
    """Every name an operator uses itself comes back with the caller's values, and which of equal rows stays doesn't change."""
    some = [(*r[:2], r[3], *[f"{c}{r[0]}" for c in CLASHES]) for r in rows if r[0] is not None and r[0] < 205]
    df = spark.createDataFrame(some, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    for stage in (quality_rules.kept_documents, jaccard_join.one_of_each, suffix_dedup.deduplicated, mixing.mixed_documents):
        out = stage(df)
        got = out.collect()
        assert out.columns == df.columns and got, stage
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES), stage
    twice = spark.createDataFrame([(1, "the same text of some words here", x) for x in "cab"], "doc_id long, text string, more string")
    assert {jaccard_join.one_of_each(twice.repartition(n, F.lit(n), "more")).first().more for n in (1, 2, 3)} == {jaccard_join.one_of_each(twice).first().more}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=8, max_size=60), min_size=1, max_size=6), st.sampled_from([8, 16, 11]))
def test_prefix_free_parsing(texts, window):
    blobs = [t.encode() for t in texts if len(t) >= window]
    if not blobs:
        return
    starts = np.array([len(b) - window + 1 for b in blobs])
    count = Counter(b[i : i + window] for b in blobs for i in range(len(b) - window + 1))
    want = [count[b[i : i + window]] > 1 for b in blobs for i in range(len(b) - window + 1)]
    assert suffix_dedup.repeated_starts(blobs, starts, window, period=4).tolist() == want


# 2


def test_quality_rules(docs, rows):
    got = by_id(quality_rules.quality_digest(docs))
    for r in rows:
        ws, t = (r[1] or "").replace("\r", "\n").split(), r[1] or ""
        grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        cover = {i + k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert want in [x[:5] for x in got[r[0]]]
        base = len(ws) < 20 or 100 * len(cover) > 30 * len(ws)
        assert all(x[5] == base and not (base and x[6]) for x in got[r[0]])
    assert got[0][0][6] and not got[408][0][6] and not got[409][0][6]
    kept = quality_rules.kept_documents(docs)
    assert kept.count() and kept.columns == docs.columns and kept.first()["kept"] == "k"
    assert quality_rules.quality_digest(docs.limit(0)).count() == 0


# 4


def test_chat_format(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l \\e <s> <|x|> [USER] \\", None, "", "<s></s><<SYS>>\n[/ASSISTANT]", "ünï"]
    rows = [(c, i, ("user", "assistant")[i % 2], t) for c in (1, 2) for i, t in enumerate(odd)] + [(None, 0, None, "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, None, "a]b[c", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("log", F.lit(1))
    got = {r.conv_id: r for r in chat_format.chat_digest(df).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "user", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.chat_digest(df.limit(0)).count() == 0
    log = [(1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "a"), (1, 2, "delta", 1, "assistant", "b"), (1, 3, "edit", 0, "user", "hello"), (1, 4, "message", None, "user", "more"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "new")]
    events = spark.createDataFrame(log, "conv_id long, seq long, op string, target long, role string, text string")
    assert [tuple(t) for t in chat_format.folded(events).first().turns] == [("user", "hello"), ("assistant", "new")]


def plain_fold(log):
    """Event by event, as the log says."""
    out = []
    for seq, op, target, role, text in sorted(log, key=lambda e: (e[0], e[3], e[4], e[1])):
        if op == "message":
            out.append([target, role, text])
        elif op == "regenerate":
            out = [m for m in out if m[0] <= target]
        for m in out if op in ("delta", "edit", "regenerate") else []:
            if m[0] == target:
                m[2] = {"delta": m[2] + text, "edit": text, "regenerate": ""}[op]
    return [(r, t) for _, r, t in out]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["message", "message", "delta", "edit", "regenerate"]), st.integers(0, 4), st.sampled_from(["user", "assistant"]), st.sampled_from(["a", "b", ""])), max_size=14), min_size=8, max_size=8))
def test_fold_of_random_logs(spark, logs):
    rows = [(c, *e) for c, log in enumerate(logs) for e in log]
    df = spark.createDataFrame(rows, "conv_id long, seq long, op string, target long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.folded(df).collect()}
    assert got == {c: x for c, log in enumerate(logs) if (x := plain_fold(log))}


def test_equal_messages_stand_in_the_order_of_their_ids(spark):
    log = [(1, 3, "message", 0, "assistant", "b"), (1, 3, "message", 3, "assistant", "b"), (1, 6, "delta", 0, "user", "a")]
    for some in (log, log[::-1]):
        events = spark.createDataFrame(some, "conv_id long, seq long, op string, target long, role string, text string")
        assert [tuple(t) for t in chat_format.folded(events).first().turns] == [("assistant", "ba"), ("assistant", "b")]


# 5


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[50:60] = x[0]  # copies of a query's vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (800, [0.0] * 16, 1), (801, [None] + [1.0] * 15, 1), (802, [float("nan")] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = defaultdict(list)
    for q in sorted(ann.nearest(df).collect(), key=lambda q: (q.query_id, q["rank"])):
        got[q.query_id].append((q.score, q.vec_id))
    assert sorted(got) == list(range(0, 700, 100))
    hit = 0
    for q in got:
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        best = sorted((float(d[i]), i) for i in range(700) if i != q)[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        assert all(abs(s - d[i]) < 1e-12 for s, i in got[q])
        hit += len({i for _, i in best} & {i for _, i in got[q]})
    assert hit >= 0.9 * 70 and [i for _, i in got[0]] == list(range(50, 60))
    few = spark.createDataFrame(rows[:4], df.schema)
    assert ann.nearest(few).count() == 3 and ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_several_lengths(spark):
    r = np.random.default_rng(5)
    x = {i: r.normal(size=4 if i in (100, 200, 7, 9) else 3 if i == 300 else 8).astype(np.float32) for i in range(400)}
    got = defaultdict(list)
    for q in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<float>")).collect():
        got[q.query_id].append((q["rank"], q.vec_id))
    for q in (0, 100, 200):
        d = sorted((float(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()), i) for i in x if i != q and len(x[i]) == len(x[q]))
        assert [i for _, i in sorted(got[q])] == [i for _, i in d[:10]]
    assert len(got[100]) == len(got[200]) == 3 and 300 not in got  # alone in its length


def test_descent_settles(spark):
    n, parts = 4000, 2
    x = np.random.default_rng(4).normal(size=(n, 24)).astype(np.float32)
    b = ann._bucket(np.arange(n), parts).tolist()
    packed = spark.createDataFrame([(b[i], 0, i, bytearray(x[i].tobytes())) for i in range(n)], ann._PACK)
    first = ann.written(ann.first_graph(packed, n, parts), "test")
    changed = lambda g: ann.descended(packed, g, parts).agg(F.sum("node")).first()[0]
    assert changed(ann.written(ann.descended(packed, first, parts), "test")) > 2 * ann.SETTLED * n * ann.DEGREE  # one pass isn't enough
    graph = ann.settled(packed, first, n, parts)
    assert changed(graph) <= ann.SETTLED * n * ann.DEGREE
    e = ann._edges({1: [(None, r.blob) for r in graph.where("kind = 1").collect()]}, 1)
    near = defaultdict(set)
    for u, v in zip(e["u"].tolist(), e["v"].tolist()):
        near[u].add(v)
    hit = sum(len(near[q] & set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist())) for q in range(0, n, 40))
    assert hit >= 0.985 * 1000
    assert ann.beam_for(1 << 10) == ann.beam_for(1 << 17) == ann.BEAM_AT[1] and ann.beam_for(1 << 21) > 3 * ann.BEAM_AT[1]


# 6


def brute_components(rows, percent=80):
    sets, root = {}, {}
    for i, r in enumerate(rows):
        w = (r[1] or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in sets:
        least[find(i)].append(rows[i][0])
    return {i: (len(sets[i]), min(least[find(i)])) for i in sets}


def test_jaccard_join(docs, rows):
    want = defaultdict(list)
    for i, x in brute_components(rows).items():
        want[rows[i][0]].append(x)
    assert by_id(jaccard_join.similar_documents(docs)) == want
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted({k for k, v in want.items() if any(c == k for _, c in v)})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 30), st.integers(1, 30)), max_size=40))
def test_positional_filter_keeps_links(postings):
    """No posting goes that still has a partner by the pair rule."""
    rows = sorted({(t, n) for t, n, _ in [(a, i, c) for i, (a, _, c) in enumerate(postings)]})
    if not rows:
        return
    size = [postings[n][2] for _, n in rows]
    place = [postings[n][1] % postings[n][2] for _, n in rows]
    token, node = np.array([t for t, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)
    t, k, n, most = jaccard_join.groups_of(token, node, np.array(size, np.uint32), np.array(place, np.uint16), 80)
    left = set(zip(t.tolist(), k.tolist()))
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows):
            if a == b and x != y and min(size[i] - place[i], size[j] - place[j]) * 180 >= 80 * (size[i] + size[j]):
                assert (a, x) in left and (b, y) in left


# 7


def test_lm_scoring(docs, rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [w.lower() for w in words(t)] + [None]
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    got = by_id(lm_scoring.lm_scores(docs))
    for r in rows:
        ts = tokens(r[1])
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)
        for h, k, known, train, base, score in got[r[0]]:
            assert (h, k, known, train) == (held(r[0]), len(ts), sum(c[w] > 0 for w in ts), n)
            assert abs(base - want) < 1e-6 and score < 0
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_lm_keeps_all_bigrams(spark):
    # Pairs met once between words met often: without them each pair of known words scores alike.
    met = [(i, f"w{i % 60} w{(i * 7 + i // 60) % 60}") for i in range(600)]
    known = Counter(t for i, t in met if zlib.crc32(str(i).encode()) % 7 != 2)
    once = next(t for t, k in known.items() if k == 1)
    a = once.split()[0]
    never = next(f"{a} w{i}" for i in range(60) if f"{a} w{i}" not in known)
    own = [d for d in range(10**6, 10**6 + 60) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    df = spark.createDataFrame([*met, (own[0], once), (own[1], never)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(df).where(F.col("doc_id") >= 10**6).collect()}
    assert got[own[0]] > got[own[1]] + 0.1


def plain_model(rows):
    """(N, V, P): the same model from plain dictionaries, counts rounded to levels; rows of (doc_id, text)."""
    mid = lambda n: float(lm_scoring.middle(lm_scoring.level_of(np.array([n])))[0])
    one, two = Counter(), Counter()
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
            ts = [None, *[w.lower() for w in words(text)], None]
            one.update(ts[1:])
            two.update(zip(ts, ts[1:]))
    total = sum(mid(c) for c in one.values())

    def p(w, v):
        single = (mid(one[w]) + 1) / (total + len(one) + 1)
        return (min(mid(two[v, w]), one[v]) + lm_scoring.PRIOR * single) / (one[v] + lm_scoring.PRIOR)

    return one, two, p


def test_lm_score_is_the_plain_model(docs, rows):
    *_, p = plain_model([(r[0], r[1]) for r in rows])
    got = by_id(lm_scoring.lm_scores(docs))
    for r in rows:
        ts = [None, *[w.lower() for w in words(r[1])], None]
        want = sum(math.log10(p(w, v)) for v, w in zip(ts, ts[1:]))
        assert any(abs(x[-1] - want) < 1e-6 for x in got[r[0]])


def test_lm_is_a_distribution(spark, sf):
    """Over the whole vocabulary and one unknown word, for contexts met often and seldom."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    one, two, p = plain_model(rows)
    often = [w for w, _ in one.most_common(12)]
    for v in [*often, *list(one)[:: len(one) // 12]]:
        # Words that never follow v share what is left by their own probability.
        follow = {w for x, w in two if x == v}
        seen = sum(p(w, v) for w in follow)
        alone = sum(p(w, object()) for w in follow)  # of an unknown context: P(w) itself
        rest = lm_scoring.PRIOR * (1 - alone) / (one[v] + lm_scoring.PRIOR)
        assert abs(seen + rest - 1) < 0.03, (v, seen + rest)


def test_lm_same_on_any_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    runs = [{r.doc_id: (r.score, r.base_score) for r in lm_scoring.lm_scores(docs.repartition(n)).collect()} for n in (1, 4, 40)]
    assert all(abs(x - y) < 1e-6 for run in runs[1:] for d in run for x, y in zip(run[d], runs[0][d]))


def test_lm_levels():
    c = np.concatenate([np.arange(0, 5000), 2 ** np.arange(13, 50)])
    q = lm_scoring.level_of(c)
    assert (np.diff(q) >= 0).all() and (lm_scoring.middle(q[:8]) == c[:8]).all()
    assert (np.abs(lm_scoring.middle(q[1:]) / c[1:] - 1) < 0.11).all()
    exact = np.arange(lm_scoring.EXACT, 5000)
    assert abs(lm_scoring.middle(lm_scoring.level_of(exact)).sum() / exact.sum() - 1) < 0.01


def test_lm_filter():
    """Every item at its level, and hardly a hit among what is not there: under 1 / (100 V)."""
    r = np.random.default_rng(3)
    h = {n: r.integers(0, 2**63, 30_000 * n).astype(np.uint64) for n in (1, 2)}
    c = {n: r.integers(1, 40, len(x)).astype(np.uint64) for n, x in h.items()}
    probes = lm_scoring.probes_for(30_000)
    assert 2.0**-probes < 1 / (100 * 30_000)
    f = lm_scoring.segment({n: (h[n], c[n]) for n in h}, probes)
    assert all((f.level(h[n], n) == lm_scoring.level_of(c[n])).all() for n in h)
    assert (f.level(r.integers(0, 2**63, 400_000).astype(np.uint64), 2) > 0).sum() == 0
    assert (lm_scoring.segment({}, 16).level(h[1], 1) == 0).all()


# 8


def test_crf_marginals_by_enumeration():
    r = np.random.default_rng(0)
    good, trans, owner = r.normal(size=7) * 2, r.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2])
    p, pairs = quality_crf.marginals(good, trans, owner)
    for chain in range(3):
        at = np.flatnonzero(owner == chain)
        total, one, two = 0.0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for code in range(2 ** len(at)):
            s = [(code >> i) & 1 for i in range(len(at))]
            w = math.exp(sum(good[k] * s[i] for i, k in enumerate(at)) + sum(trans[s[i], s[i + 1]] for i in range(len(at) - 1)))
            total += w
            for i in range(len(at)):
                one[i] += w * s[i]
                if i + 1 < len(at):
                    two[i, s[i], s[i + 1]] += w
        assert np.allclose(p[at], one / total) and np.allclose(pairs[at], two / total)


def test_quality_crf(spark, docs, labels):
    got = quality_crf.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality_crf.quality_scores(docs, labels.limit(0)).first().score == 0.5
    assert quality_crf.quality_scores(docs.limit(0), labels).count() == 0


def test_crf_held_out_accuracy(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet")
    got = quality_crf.quality_scores(t("documents"), t("labels")).where("held_out").join(t("labels"), "doc_id")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first()
    assert r.a > 0.95


# 9


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    plan, levels = mixing.mixture_plan(docs, shard=200)
    got = plan.collect()
    assert len(got) == len(rows) and levels > 4
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= s < 1 << levels for s in r.shards)
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(want[s] - taken[s]) <= max(60, 0.02 * want[s])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture_digest(docs.limit(0)).count() == 0


def test_mixing_reruns_agree(spark, docs, rows, monkeypatch):
    """The same mix from the rows in other orders and partitions, over many blocks and a deep tree."""
    monkeypatch.setattr(mixing, "BLOCK", 4)
    want, names = None, docs.columns
    for parts in (1, 4, 7):
        some = docs.orderBy(F.xxhash64(F.lit(parts), "text")).coalesce(1) if parts == 1 else docs.repartition(parts, F.col("text"), F.lit(parts))
        plan, _ = mixing.mixture_plan(some, shard=50)
        got = sorted((repr((r.doc_id, r.source, r.size, r.target)), r.copies, tuple(r.shards)) for r in plan.collect())
        mix = sorted(repr(tuple(r)) for r in mixing.mixed_documents(some, shard=500).collect())
        assert want in (None, (got, mix))
        want = (got, mix)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "quotas" in text and "_shard" in text  # the copies come from the tree's shards
    digest = mixing.mixture_digest(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "quotas" in digest and mixing.mixed_documents(docs).columns == names


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 60), st.integers(0, 60), st.integers(0, 60), st.floats(0, 0.999999))
def test_hypergeometric_quantiles(spark, n, k, m, u):
    k, m = min(k, n), min(m, n)
    weights = [math.comb(k, i) * math.comb(n - k, m - i) for i in range(0, min(k, m) + 1)]
    below = [sum(weights[:i]) / sum(weights) for i in range(len(weights))]
    got = spark.range(1).select(mixing.hypergeometric(F.lit(k), F.lit(m), F.lit(n), F.lit(u))).first()[0]
    assert weights[got] > 0 or got == 0
    assert below[got] <= u + 1e-9 and (got + 1 >= len(below) or below[got + 1] > u - 1e-9)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.integers(0, 500), min_size=1, max_size=7))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").coalesce(1)
    want = brute_targets(sizes)
    for r in mixing.targets(df).collect():
        assert abs(r.target - want[r.source]) < 1e-6


def test_split_tree_keeps_quotas(spark):
    df = spark.createDataFrame([([7, 0, 20, 1, 5],)], "quotas array<int>")
    quotas = np.array([r.quotas for r in mixing.split_tree(df, 3).orderBy("shard").collect()])
    assert quotas.shape == (8, 5) and quotas.sum(0).tolist() == [7, 0, 20, 1, 5] and quotas.min() >= 0
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 1
