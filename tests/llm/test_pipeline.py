"""The pipeline's stages over the odd cases: what each drops, keeps and returns."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
from millrace.llm import mixing, oracles
from millrace.llm.common import written
from tests.llm.test_tokens import brute_best_fit, whole


def test_stages(spark, docs):
    at, cols = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at.select(*[c for c in cols if c != "kept"]), ""), "test-stage")
        seen.append({r.doc_id for r in at.collect()})
        assert at.columns == [c for c in cols if c != "kept"], name
    rules, near, cut, mix = seen
    assert 0 in rules and not rules & {400, 401, 402, 403, 407, 408, 409}
    assert 3 in near and not near & {100, 101, 102, 103, 200, 201, 202, 203} and near < rules
    assert cut <= near and mix <= cut and 0 in cut
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, "")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(pieces.columns) and pieces.count() >= at.count()


def test_empty(spark, docs):
    at = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, ""), "test-stage")
        assert at.count() == 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.where("offset + length > 2048").count() == 0


def shingles(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(lower)) if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def groups(texts):
    """The sets of places of texts that are linked, directly or over others."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    return [{i for i, x in enumerate(of) if x == k} for k in set(of)]


def test_stages_against_plain_versions(spark, docs):
    """Each stage on what the one before it kept: the rules by SQL, the others by plain Python."""
    cols = [c for c in docs.columns if c != "kept"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    at = docs.select(*cols)
    db = duckdb.connect()
    db.register("documents", at.toPandas())
    keeps = {r[0] for r in db.execute(oracles.oracle_sql()["op2_quality_rules"].strip().join(["SELECT doc_id FROM (", ") WHERE kept"])).fetchall()}
    at = written(stages[0](spark, at, ""), "test-plain")
    rows = at.collect()
    assert {r.doc_id for r in rows} == keeps and all(r.text for r in rows)

    kept = written(stages[1](spark, at, ""), "test-plain")
    stay = [(r.doc_id, r.text) for r in kept.collect()]
    found = groups([r.text for r in rows])
    assert len(stay) == len(found) and all(sum((rows[i].doc_id, rows[i].text) in stay for i in g) >= 1 for g in found)

    cut = written(stages[2](spark, kept, ""), "test-plain")
    want = {}
    for (doc, text), gone in zip(stay, removed([t.encode() for _, t in stay])):
        place, left = 0, []
        for c in text:
            n = len(c.encode())
            left += [c] if not all(gone[place : place + n]) else []
            place += n
        if re.search(r"[^\x20\x09-\x0D]", "".join(left)):
            want[doc] = "".join(left)
    assert {r.doc_id: r.text for r in cut.collect()} == want

    mix = written(stages[3](spark, cut, ""), "test-plain")
    copies = Counter(r.doc_id for r in mix.collect())
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in want.items()}
    taken = {r.doc_id: r.taken for r in mixing.mixture_digest(cut).collect()}
    assert all(copies[d] * size[d] == taken[d] and copies[d] <= 3 for d in want)

    pieces = stages[4](spark, mix, "").collect()
    ids = {d: len(whole(t)) + 1 for d, t in want.items()}
    assert sum(r.length for r in pieces) == sum(copies[d] * ids[d] for d in copies)
    lengths = [n for d, k in copies.items() for n in [ids[d] % 2048 or 2048] * k + [2048] * (k * ((ids[d] - 1) // 2048))]
    assert len({r.sequence_id for r in pieces}) == len(brute_best_fit(lengths, 2048)) and sorted(r.length for r in pieces) == sorted(lengths)


def removed(texts, window=200):
    """For each text which of its bytes a repeated string covers."""
    count, out = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1)), []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out
