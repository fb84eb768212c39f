"""Operator 5: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node (with the least ids of its rows, as many as any answer can need), so a vector with many copies
is one point. A first graph comes from random-projection leaves of a bounded size. NN-descent then joins, round after
round, each node's neighbours with each other: a node's forward and reverse neighbours are gathered by a join on the
node, their vectors by a join on the neighbour, and what beats a neighbour's worst is sent back by a join on it. Rounds
go on until one changes fewer than SETTLED of all edges; edges only get shorter, so they end.

Queries are searched in blocks of stated ids: all start from their own node, expand the best nodes not yet expanded, and
keep the nearest (a beam of 512, which grows with tables over 131,072 vectors), with one join for the neighbours of what is expanded and one for
their distances a round. All rows are indexed; candidates aren't capped, only the beam is. Scores are double-precision distances between original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of several lengths are searched each
among those of its own length, one length after the other; a query alone in its length finds nothing. Null ids take no part; equal ids are different rows; fewer rows than asked for are all returned; extra columns are ignored."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import dropped, int_parts, written

DEGREE = 24
REVERSE = 24
TREES = 6
LEAF = 512
SETTLED = 0.01  # of n * DEGREE: a round that changes fewer edges is the last
BEAM_AT = (1 << 17, 512)  # up to so many vectors the beam is this; beyond it grows as n ** BEAM_POWER
BEAM_POWER = 0.7
STEP = 512
TOP = 10
PART = 2048  # vectors a bucket
_PACK = "bucket int, kind int, node long, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("node", pa.int64()), ("blob", pa.binary())])


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], t.type) for t in _SCHEMA], schema=_SCHEMA)


def beam_for(n: int) -> int:
    """The beam over n vectors: the one that holds recall grows with the table."""
    return max(BEAM_AT[1], int(np.ceil(BEAM_AT[1] * (n / BEAM_AT[0]) ** BEAM_POWER)))


def _bucket(node: np.ndarray, parts: int) -> np.ndarray:
    return (K.mixed(np.asarray(node, np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _by_bucket(node: np.ndarray, parts: int, *cols: np.ndarray):
    """(bucket, columns) of rows dealt by the bucket of node."""
    b = _bucket(node, parts)
    o = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[o], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        i = o[edges[p] : edges[p + 1]]
        yield p, [c[i] for c in cols]


def _tasks(df: DataFrame, parts: int, work) -> DataFrame:
    """work({kind: [(node, blob)]}) -> rows, once for each bucket; a task holds one bucket at a time."""

    def run(batches):
        bucket, held = None, {}
        for batch in batches:
            for b, k, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and held:
                    yield from _sliced(work(held))
                    held = {}
                bucket = b
                held.setdefault(k, []).append((n, x))
        if held:
            yield from _sliced(work(held))

    def _sliced(rows):
        part, size = [], 0
        for r in rows:
            part.append(r)
            size += len(r[3])
            if size > 1 << 23:
                yield _rows(part)
                part, size = [], 0
        if part:
            yield _rows(part)

    tasks = min(int_parts(df.sparkSession), max(parts, 12))
    return df.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PACK)


def sound_rows(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are equal numbers.
    return df.where(F.coalesce(sound, F.lit(False)) & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.transform(v, lambda x: x + 0.0).alias("v"))


def vector_nodes(rows: DataFrame, top: int) -> DataFrame:
    """(node, v, ids) of rows (id, v): one row a different vector; node is a hash of it, ids the top + 1 least ids of its rows."""
    # The least ids of each vector: ranked within salts first, so one vector's copies aren't sorted in one task.
    keyed = rows.select("id", "v", F.xxhash64("v").alias("node"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    some = keyed.groupBy("node", "salt").agg(F.slice(F.array_sort(F.collect_list("id")), 1, top + 1).alias("ids"), F.first("v").alias("v"))
    return some.groupBy("node").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, top + 1).alias("ids"))


_EDGE = np.dtype([("u", "<i8"), ("v", "<i8"), ("d", "<f4")])


def _best(edges: np.ndarray, degree: int) -> np.ndarray:
    """The degree nearest different v of each u, sorted by u and distance."""
    e = edges[np.lexsort((edges["d"], edges["v"], edges["u"]))]
    keep = np.ones(len(e), bool)
    keep[1:] = (e["u"][1:] != e["u"][:-1]) | (e["v"][1:] != e["v"][:-1])
    e = e[keep & (e["u"] != e["v"])]
    e = e[np.lexsort((e["d"], e["u"]))]
    if not len(e):
        return e
    first = np.flatnonzero(np.append(True, e["u"][1:] != e["u"][:-1]))
    place = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
    return e[place < degree]


def _distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    return np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0)


def _pairs_of(ids: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest of each row of x among the others, as edges."""
    if len(ids) < 2:
        return np.zeros(0, _EDGE)
    d = _distances(x)
    np.fill_diagonal(d, np.inf)
    k = min(degree, len(ids) - 1)
    near = np.argpartition(d, k - 1, 1)[:, :k]
    out = np.zeros(near.size, _EDGE)
    out["u"], out["v"], out["d"] = np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()
    return out


def _blobs(edges: np.ndarray, parts: int, kind: int, key: str = "u") -> list:
    return [(p, kind, None, c.tobytes()) for p, (c,) in _by_bucket(edges[key], parts, edges)]


def _edges(held: dict, kind: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, _EDGE) for _, x in held.get(kind, [])]) if held.get(kind) else np.zeros(0, _EDGE)


def _vectors(held: dict, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sorted nodes, float32 vectors) of packed rows."""
    rows = held.get(kind, [])
    ids = np.array([n for n, _ in rows], np.int64)
    x = np.stack([np.frombuffer(b, "<f4") for _, b in rows]) if rows else np.zeros((0, 1), np.float32)
    o = np.argsort(ids)
    return ids[o], x[o]


def _both(e: np.ndarray, parts: int) -> list:
    """Edges (kind 1) to the bucket of their own node, a row's node counting those marked new, and turned round (kind 2) to the other end's."""
    r = e.copy()
    r["u"], r["v"] = e["v"], e["u"]
    return _blobs(e, parts, 1) + _blobs(r, parts, 2)


def first_graph(packed: DataFrame, n: int, parts: int, trees: int = TREES, leaf: int = LEAF, degree: int = DEGREE) -> DataFrame:
    """Edges (kinds 1 and 2) from the leaves of random projections: each tree sends a node to the leaf of its signs."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / (leaf / 2))))))

    def dealt(batches):
        for batch in batches:
            ids = batch.column(2).to_numpy()
            if not len(ids):
                continue
            x = np.stack([np.frombuffer(b, "<f4") for b in batch.column(3).to_pylist()])
            rows = []
            for t in range(trees):
                planes = np.random.default_rng(1000 + t).normal(size=(x.shape[1], bits)).astype(np.float32)
                code = ((x @ planes > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(1) if bits else np.zeros(len(x), np.int64)
                rows += [(t * (1 << bits) + c, 0, i, v.tobytes()) for c, i, v in zip(code.tolist(), ids.tolist(), x)]
            for at in range(0, len(rows), 20_000):
                yield _rows(rows[at : at + 20_000])

    def leaves(held):
        ids, x = _vectors(held)
        out = []
        # A leaf can be uneven: it is cut along one more direction into parts of the bounded size, two ways.
        for turn in range(2):
            w = np.random.default_rng(7 + turn).normal(size=x.shape[1]).astype(np.float32)
            o = np.argsort(x @ w)
            out += [_pairs_of(ids[o[a : a + leaf]], x[o[a : a + leaf]], degree) for a in range(0, len(ids), leaf)]
            if len(ids) <= leaf:
                break
        return _blobs(_best(np.concatenate(out), degree), parts, 1)

    dealt_out = packed.mapInArrow(dealt, _PACK)
    found = _tasks(dealt_out, parts, leaves)
    return _tasks(found, parts, lambda held: _both(_best(_edges(held, 1), degree), parts))


def descended(packed: DataFrame, graph: DataFrame, parts: int, degree: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """One round of NN-descent: neighbours of a node are compared with each other. A row's node counts its new edges.

    Each node sends its vector to its neighbours both ways, each of those compares all pairs of what came, and what beats a
    neighbour's worst goes back to it: three exchanges, by bucket of the node."""

    def sent(held):  # a node's vector and worst distance to whoever it is a forward or reverse neighbour of
        ids, x = _vectors(held)
        e, r = _edges(held, 1), _edges(held, 2)
        worst = np.full(len(ids), np.inf, np.float32)
        if len(e):
            u, k = np.unique(e["u"], return_counts=True)
            full = np.searchsorted(ids, u[k >= degree])
            np.maximum.at(m := np.full(len(ids), -np.inf, np.float32), np.searchsorted(ids, e["u"]), e["d"])
            worst[full] = m[full]
        half = np.dtype([("u", "<i8"), ("v", "<i8"), ("d", "<f4"), ("f", "u1"), ("w", "<f4"), ("x", "<f4", (x.shape[1],))])
        out = _blobs(e, parts, 1)
        for edges, forward in ((r, 1), (e, 0)):  # turned edges go back to those who have this node as a neighbour
            for at in range(0, len(edges), 20_000):
                some = edges[at : at + 20_000]
                i = np.searchsorted(ids, some["u"])
                full = np.zeros(len(some), half)
                full["u"], full["v"], full["d"], full["f"], full["w"], full["x"] = some["v"], some["u"], some["d"], forward, worst[i], x[i]
                out += [(p, 4, x.shape[1], c.tobytes()) for p, (c,) in _by_bucket(full["u"], parts, full)]
        return out

    def joined(held):  # all pairs of the forward and nearest reverse neighbours of a node that beat the worst of one of them
        found = []
        if held.get(4):
            d = held[4][0][0]
            half = np.dtype([("u", "<i8"), ("v", "<i8"), ("d", "<f4"), ("f", "u1"), ("w", "<f4"), ("x", "<f4", (d,))])
            rows = np.concatenate([np.frombuffer(b, half) for _, b in held[4]])
            o = np.lexsort((rows["v"], rows["d"], 1 - rows["f"].astype(np.int8), rows["u"]))
            u = rows["u"][o]
            first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            for a, b in zip(first.tolist(), np.append(first[1:], len(u)).tolist()):
                i = o[a:b]
                i = i[: int(rows["f"][i].sum()) + reverse]  # forward ones come first, then reverse ones by distance
                v, w, x = rows["v"][i], rows["w"][i], rows["x"][i]
                v, one = np.unique(v, return_index=True)
                w, x = w[one], x[one]
                dist = _distances(x)
                i, j = np.nonzero(dist < w[:, None])
                keep = i != j
                e = np.zeros(int(keep.sum()), _EDGE)
                e["u"], e["v"], e["d"] = v[i[keep]], v[j[keep]], dist[i[keep], j[keep]]
                found.append(e)
        new = _best(np.concatenate(found), degree) if found else np.zeros(0, _EDGE)
        return _blobs(new, parts, 3) + _blobs(_edges(held, 1), parts, 1)

    def kept(held):
        old = _edges(held, 1)
        e = _best(np.concatenate([old, _edges(held, 3)]), degree)
        had, have = (K.mixed(np.ascontiguousarray(x["u"]).view(np.uint64) ^ K.mixed(np.ascontiguousarray(x["v"]).view(np.uint64))) for x in (old, e))
        changed = ~np.isin(have, had)
        own = [(p, 1, int(c.sum()), x.tobytes()) for p, (x, c) in _by_bucket(e["u"], parts, e, changed)]
        return own + [x for x in _both(e, parts) if x[1] == 2]

    vectors = _tasks(graph.union(packed), parts, sent)
    return _tasks(_tasks(vectors, parts, joined), parts, kept)


def settled(packed: DataFrame, graph: DataFrame, n: int, parts: int, share: float = SETTLED, degree: int = DEGREE) -> DataFrame:
    """The graph after rounds of NN-descent, the last of which changed fewer than that share of n * degree edges."""
    while True:
        last, graph = graph, written(descended(packed, graph, parts, degree), "ann-graph")
        dropped(last)
        if (graph.where("kind = 1").agg(F.sum("node")).first()[0] or 0) <= share * n * degree:
            return graph


def adjacency(graph: DataFrame, parts: int, degree: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """Packed lists of each node's forward and nearest reverse neighbours (kind 5), by bucket."""

    def listed(held):
        e = np.concatenate([_edges(held, 1), _best(_edges(held, 2), 2 * reverse)])
        return _blobs(np.unique(e), parts, 5)

    return _tasks(graph, parts, listed)


def _state(beam: np.ndarray, dist: np.ndarray, open_: np.ndarray, seen: np.ndarray, vector: bytes) -> bytes:
    head = np.array([len(beam), len(seen), len(vector)], "<i8").tobytes()
    return head + beam.astype("<i8").tobytes() + dist.astype("<f4").tobytes() + open_.astype("u1").tobytes() + seen.astype("<i8").tobytes() + vector


def _opened(blob: bytes):
    n, m, k = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    out = []
    for kind, size in (("<i8", n), ("<f4", n), ("u1", n), ("<i8", m)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    return (*out, blob[at : at + k])


def searched(nodes: DataFrame, packed: DataFrame, lists: DataFrame, queries: DataFrame, parts: int, beam: int = BEAM_AT[1], step: int = STEP) -> DataFrame:
    """State rows (kind 6) of the queries (node, v) when nothing in their beams is left to expand."""
    q = queries.select(F.lit(0).alias("bucket"), F.lit(6).alias("kind"), "node", F.col("blob"))

    def begun(batches):
        for batch in batches:
            ids = batch.column(2).to_pylist()
            if not ids:
                continue
            rows = []
            b = _bucket(np.array(ids, np.int64), parts)
            for p, i, v in zip(b.tolist(), ids, batch.column(3).to_pylist()):
                own = np.array([i], np.int64)
                rows.append((p, 6, i, _state(own, np.zeros(1), np.ones(1), own, v)))
            yield _rows(rows)

    def expanding(held):  # the nearest open nodes of each beam ask for their neighbours
        out, asks = [], []
        for i, blob in held.get(6, []):
            ids, dist, open_, seen, v = _opened(blob)
            go = np.flatnonzero(open_)[:step]
            if len(go):
                left = open_.copy()
                left[go] = 0
                asks.append(np.stack([ids[go], np.full(len(go), i)], 1))
                blob = _state(ids, dist, left, seen, v)
            out.append((int(_bucket(np.array([i]), parts)[0]), 6, i, blob))
        if asks:
            a = np.concatenate(asks)
            out += [(p, 7, None, c.tobytes()) for p, (c,) in _by_bucket(a[:, 0], parts, a)]
        return out

    def neighbours(held):  # lists of the asked nodes, back to the query
        e = np.concatenate([np.frombuffer(x, _EDGE) for _, x in held[5]]) if held.get(5) else np.zeros(0, _EDGE)
        e = e[np.argsort(e["u"], kind="stable")]
        out = [(int(_bucket(np.array([i]), parts)[0]), 6, i, b) for i, b in held.get(6, [])]
        for _, b in held.get(7, []):
            a = np.frombuffer(b, "<i8").reshape(-1, 2)
            lo, hi = np.searchsorted(e["u"], a[:, 0], "left"), np.searchsorted(e["u"], a[:, 0], "right")
            n = hi - lo
            i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pair = np.unique(np.stack([np.repeat(a[:, 1], n), e["v"][i]], 1), axis=0)
            out += [(p, 8, None, c.tobytes()) for p, (c,) in _by_bucket(pair[:, 0], parts, pair)]
        return out

    def wanted(held):  # nodes that a query hasn't seen ask for their distance to it
        found = np.unique(np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 2) for _, b in held[8]]), axis=0) if held.get(8) else np.zeros((0, 2), np.int64)
        out = []
        for i, blob in held.get(6, []):
            ids, dist, open_, seen, v = _opened(blob)
            lo, hi = np.searchsorted(found[:, 0], [i, i + 1]) if i < np.iinfo(np.int64).max else (np.searchsorted(found[:, 0], i), len(found))
            new = np.setdiff1d(found[lo:hi, 1], seen)
            if len(new):
                blob = _state(ids, dist, open_, np.concatenate([seen, new]), v)
                out += [(p, 9, i, np.array([len(c)], "<i8").tobytes() + c.astype("<i8").tobytes() + v) for p, (c,) in _by_bucket(new, parts, new)]
            out.append((int(_bucket(np.array([i]), parts)[0]), 6, i, blob))
        return out

    def measured(held):  # distances of the asked nodes, back to the query
        ids, x = _vectors(held)
        out = [(int(_bucket(np.array([i]), parts)[0]), 6, i, b) for i, b in held.get(6, [])]
        for i, b in held.get(9, []):
            n = int(np.frombuffer(b, "<i8", 1)[0])
            c, v = np.frombuffer(b, "<i8", n, 8), np.frombuffer(b, "<f4", -1, 8 + 8 * n)
            y = x[np.searchsorted(ids, c)] - v
            out.append((int(_bucket(np.array([i]), parts)[0]), 10, i, c.tobytes() + (y * y).sum(1).astype("<f4").tobytes()))
        return out

    def merged(held):  # what came back enters the beams, which then ask anew
        got: dict[int, list] = {}
        for i, b in held.get(10, []):
            got.setdefault(i, []).append(b)
        out = []
        for i, blob in held.get(6, []):
            if i in got:
                ids, dist, open_, seen, v = _opened(blob)
                new = [(np.frombuffer(b, "<i8", len(b) // 12), np.frombuffer(b, "<f4", len(b) // 12, 8 * (len(b) // 12))) for b in got[i]]
                ids = np.concatenate([ids, *(a for a, _ in new)])
                dist = np.concatenate([dist, *(d for _, d in new)])
                open_ = np.concatenate([open_, np.ones(len(ids) - len(open_), np.uint8)])
                o = np.lexsort((ids, dist))[:beam]
                blob = _state(ids[o], dist[o], open_[o], seen, v)
            out.append((i, blob))
        return expanding({6: out})

    state = written(_tasks(q.mapInArrow(begun, _PACK), parts, expanding), "ann-search")
    while state.where("kind = 7").limit(1).count():
        named = _tasks(state.union(lists), parts, neighbours)
        far = _tasks(_tasks(named, parts, wanted).union(packed), parts, measured)
        last, state = state, written(_tasks(far, parts, merged), "ann-search")
        dropped(last)
    return state.where("kind = 6")


def nearest(df: DataFrame, every: int = 100, top: int = TOP, id_: str = "vec_id", vector: str = "embedding", beam: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the top found for each row whose id is divisible by every, all rows being candidates but its own.

    Vectors of different lengths have no distance: each length is searched among its own."""
    rows = sound_rows(df, id_, vector)
    lengths = sorted(r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()) or [0]
    return reduce(DataFrame.union, [_nearest(rows.where(F.size("v") == d), every, top, beam) for d in lengths])


def _nearest(vectors: DataFrame, every: int, top: int, beam: int | None) -> DataFrame:
    """nearest() of rows (id, v) of one length."""
    nodes = written(vector_nodes(vectors, top), "ann-nodes")
    n = nodes.count()
    parts = max(1, -(-n // PART))  # buckets follow the vectors, so a bucket's arrays have a bounded size

    def packed_rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                x = [np.array(v, "<f4").tobytes() for v in batch.column(1).to_pylist()]
                yield _rows([(int(b), 0, int(i), v) for b, i, v in zip(_bucket(ids, parts), ids, x)])

    packed = written(nodes.select("node", "v").mapInArrow(packed_rows, _PACK), "ann-vectors")
    graph = settled(packed, written(first_graph(packed, n, parts), "ann-graph"), n, parts)
    lists = written(adjacency(graph, parts), "ann-lists")

    # The stated queries; equal ones are searched once.
    good = vectors.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q"))
    asked = good.select(F.col("q").alias("node")).distinct()
    blobs = packed.select("node", "blob").join(asked, "node", "left_semi")
    state = searched(nodes, packed, lists, blobs, parts, beam or beam_for(n))

    def beams(batches):
        for batch in batches:
            out = []
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, dist, _, _, _ = _opened(b)
                # Some more than asked for, and all that single precision can't tell from the last of those.
                last = min(len(ids), 4 * top + 8) - 1
                out += [(i, x) for x in ids[dist <= dist[last] * np.float32(1.0001)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["q", "node"])

    # The nearest of each beam in double precision, ties to smaller ids; each node stands for its rows.
    found = state.select("node", "blob").mapInArrow(beams, "q long, node long")
    v = nodes.select(F.col("node").alias("_n"), F.col("v").alias("_v"), F.col("ids").alias("_ids"))
    qv = nodes.select(F.col("node").alias("_q"), F.col("v").alias("_qv"))
    pairs = found.join(v, F.col("node") == F.col("_n")).join(qv, F.col("q") == F.col("_q"))
    score = F.sqrt(F.aggregate(F.zip_with("_qv", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    near = pairs.select("q", F.explode(F.transform("_ids", lambda i: F.struct(score.alias("score"), i.alias("vec_id")))).alias("c"))
    best = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("c")), 1, top + 1).alias("best"))
    # A query's own row goes once; rows with its id but another vector, or more copies of it, stay.
    others = F.transform(
        F.array(F.array_position(F.transform("best", lambda b: (b["vec_id"] == F.col("query_id")) & (b["score"] == 0)), True)),
        lambda at: F.slice(F.filter("best", lambda b, i: i + 1 != at), 1, top),
    )[0]
    out = good.join(best, "q").select("query_id", F.posexplode(others).alias("_r", "b"))
    return out.select("query_id", (F.col("_r") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
