"""Exact searches against a scan: random and clustered codes, equal ones, hot buckets, ties, odd sizes."""

import numpy as np
import pytest

from millrace.operators import nearest as N
from millrace.operators import vectors


def scan(ids, asked, distances, k):
    """[(query, id, distance, rank)] of a matrix of distances."""
    out = []
    for q, d in zip(asked, distances):
        out += [(q, i, x, r + 1) for r, (x, i) in enumerate(sorted(zip(d.tolist(), ids))[:k])]
    return sorted(out)


def collected(df):
    return sorted((r.query_id, r.row_id, r.distance, r.rank) for r in df.collect())


def frames(spark, codes, asked):
    rows = spark.createDataFrame([(i, [int(w) for w in c.view(np.int64)]) for i, c in enumerate(codes)] + [(-1, None)], "row_id long, v array<long>")
    return rows, rows.where(rows.row_id.isin([int(a) for a in asked]) | (rows.row_id == -1)).withColumnRenamed("row_id", "query_id")


def codes_of(kind, n, words, r):
    if kind == "random":
        return r.integers(0, 2**64, (n, words), dtype=np.uint64)
    centres = r.integers(0, 2**64, (5, words), dtype=np.uint64)
    out = centres[r.integers(0, 5, n)]
    if kind == "clustered":  # a few bits apart
        for _ in range(3):
            out[np.arange(n), r.integers(0, words, n)] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    elif kind == "one part":  # all alike but for the last bits
        out = np.repeat(centres[:1], n, 0)
        out[:, -1] ^= r.integers(0, 2**20, n).astype(np.uint64)
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "one part"])
@pytest.mark.parametrize("words, hot", [(1, 4096), (2, 7)])
def test_multi_index(spark, kind, words, hot):
    r = np.random.default_rng(words)
    codes, asked = codes_of(kind, 700, words, r), [3, 77, 250, 699]
    rows, queries = frames(spark, codes, asked)
    want = scan(range(700), asked, N.hamming_distance(codes[asked], codes), 6)
    assert collected(N.multi_index_top(rows, queries, 6, 64 * words, hot)) == want
    assert collected(N.block_top(rows, queries, 6, N.hamming_distance, np.uint64)) == want


def test_radius_grows_and_the_rest_is_scanned(spark, monkeypatch):
    """Queries in clusters end early; those that would ask for too many buckets are searched in blocks."""
    r = np.random.default_rng(9)
    codes = np.concatenate([codes_of("clustered", 600, 2, r), codes_of("random", 40, 2, r)])
    asked, scanned = [0, 1, 2, 630, 639], []
    block = N.block_top
    monkeypatch.setattr(N, "block_top", lambda rows, queries, *a: scanned.append({x.query_id for x in queries.collect()}) or block(rows, queries, *a))
    rows, queries = frames(spark, codes, asked)
    assert collected(N.multi_index_top(rows, queries, 5, 128)) == scan(range(640), asked, N.hamming_distance(codes[asked], codes), 5)
    assert scanned and 0 not in scanned[0] and scanned[0] & {630, 639}


def test_parts():
    r = np.random.default_rng(1)
    codes = r.integers(0, 2**64, (50, 2), dtype=np.uint64)
    p = N.Parts(100, 5000)
    bits = "".join(f"{w:064b}" for w in codes[0].tolist())[:100]
    assert [int(bits[a:b], 2) for a, b in zip(p.edges, p.edges[1:])] == p.values(codes)[0].tolist()
    for x in range(p.n):
        f = p.flips(x, 2)
        assert len(set(f.tolist())) == len(f) and (np.bitwise_count(f) == 2).all()


def test_few_rows_and_none(spark):
    codes = np.arange(3, dtype=np.uint64).reshape(3, 1)
    rows, queries = frames(spark, codes, [0, 2])
    assert len(collected(N.multi_index_top(rows, queries, 10, 64))) == 6
    assert N.multi_index_top(rows.limit(0), queries, 3, 64).count() == 0 and N.multi_index_top(rows, queries.limit(0), 3, 64).count() == 0


def test_blocks(spark):
    """Many blocks on both sides, equal vectors, zero vectors, nulls."""
    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (900, 4)).astype(float)
    v[5] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "row_id long, v array<double>")
    queries = rows.where("row_id % 50 = 5 or row_id = 9999").withColumnRenamed("row_id", "query_id")
    asked = list(range(5, 900, 50))
    want = scan(range(900), asked, N.cosine_distance(v[asked], v), 7)
    for sizes in ((1 << 15, 1 << 12), (100, 4)):
        assert collected(N.block_top(rows, queries, 7, N.cosine_distance, np.float64, *sizes)) == want


def test_plans(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    for search in (vectors.hamming_top, vectors.cosine_top):
        plan = search(e, e.where("vec_id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_copies_are_searched_once_and_asks_are_bounded(spark, monkeypatch):
    """Copies of codes and queries reach no scan and no index; asks in all stay under their number, the rest is scanned."""
    r = np.random.default_rng(6)
    codes = np.repeat(codes_of("random", 40, 1, r), 30, 0)[r.permutation(1200)]
    asked, seen = list(range(0, 1200, 3)), []
    block = N.block_top
    monkeypatch.setattr(N, "block_top", lambda rows, queries, *a: seen.append((rows.count(), queries.count())) or block(rows, queries, *a))
    rows, queries = frames(spark, codes, asked)
    want = scan(range(1200), asked, N.hamming_distance(codes[asked], codes), 35)
    assert collected(N.multi_index_top(rows, queries, 35, 64)) == want
    assert seen and all(a <= 40 and b <= 40 for a, b in seen)
    codes = codes_of("random", 900, 2, r)
    rows, queries = frames(spark, codes, [5, 700])
    monkeypatch.setattr(N, "MOST_ASKS", 0)
    asks = []
    monkeypatch.setattr(N, "_once", lambda parts: asks.append(parts))
    assert collected(N.multi_index_top(rows, queries, 4, 128)) == scan(range(900), [5, 700], N.hamming_distance(codes[[5, 700]], codes), 4)
    assert not asks and seen[-1] == (900, 2)
