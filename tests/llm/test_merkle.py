"""The Merkle manifest against a plain version: odd rows, several heights, equal rows, any partitioning."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout=16):
    """The root, and for each node its (left, right) siblings upwards."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            g = a // fanout * fanout
            paths[i].append(("".join(level[g:a]), "".join(level[a + 1 : g + fanout])))
        at = [a // fanout for a in at]
        level = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    lower, by = str.maketrans(merkle.UPPER, merkle.LOWER), {}
    for r in rows:
        own = other = digest(*map(encoded, r))
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            other = digest(*map(encoded, [*r[:4], r[4].translate(lower)]))
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(((r[0] is not None, r[0] or 0), own, other))
    lows = [(sorted(by[s]), *tree([x[1] for x in sorted(by[s])])) for s in sorted(by)]
    root, tops = tree([sub for _, sub, _ in lows])
    out = []
    for (leaves, sub, paths), top in zip(lows, tops):
        for ((there, doc), own, other), path in zip(leaves, paths):
            at = other
            for left, right in path + top:
                at = digest(left, at, right)
            out.append((doc if there else None, own, sub, root, digest(*[x for p in path + top for x in p]), at, at == root))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in merkle.manifest_digest(df).collect()], key=str)


def test_odd_rows(docs, rows):
    assert found(docs) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert merkle.manifest_digest(docs.limit(0)).count() == 0
    assert merkle.manifest_digest(docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 16, 17, 256, 257, 300], [1] * 40])
def test_heights(spark, sizes):
    rows = [(100 * k + i - 50, f"s{'é' * (k % 3)}{k}" if k else None, "en", i, f"Text {i % 7} of {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert found(spark.createDataFrame(rows, FIELDS)) == brute(rows)


def test_equal_rows_and_partitions(spark):
    rows = [(5, "s", "en", 1, "Same")] * 40 + [(None, "s", None, None, None)] * 3 + [(i, "s", "en", 2, "x" * i) for i in range(30)]
    df = spark.createDataFrame(rows, FIELDS).withColumn("part", F.lit("clash")).withColumn("node", F.lit(1))
    want = brute(rows)
    for n in (1, 7):
        assert found(df.repartition(n)) == want


def test_very_long_text(spark):
    rows = [(i, "s", "en", 1, "Ab " * 500_000 if i == 5 else "Ab") for i in range(20)]
    assert found(spark.createDataFrame(rows, FIELDS)) == brute(rows)


def test_tampering_shows_only_where_letters_change(spark):
    rows = [(i, "s", "en", 1, ("Has Capitals", "none here", None)[i % 3]) for i in range(60)]
    got = {r.doc_id: r.verified for r in merkle.manifest_digest(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {r[0]: not (zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 3 == 0) for r in rows} and False in got.values()
