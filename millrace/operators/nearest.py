"""Exact nearest rows of stated queries: a search in blocks for any distance, multi-index hashing for bits.

In blocks, both sides are dealt out, and each pair of blocks is one task's group of bounded size: a matrix of distances, of
which the k least of each query leave the task. So at most k rows for each query and block are shuffled and ranked.

Multi-index hashing cuts codes into parts of about log2(codes) bits. Two codes that differ in fewer than parts * (r + 1) bits
differ in at most r bits of some part. So the codes that share a part with a query up to r flipped bits, an equi-join, hold
all that are nearer than that; r grows until a query's k-th distance is within the bound, and only the other queries go on.
Those that would ask for more buckets than a scan of the codes is worth, or than a fixed number, are searched in blocks of codes. Equal codes are one code with its k
least rows, and buckets with more than hot codes are split. Both ways are exact, ties by the row's id.

Rows and queries with null vectors take no part; a vector of zeros has no direction, and its cosine is 0. All vectors are of
one length. An empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.shared import written

ROW_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 12
CELLS = 1 << 22  # distances in memory together
PROBE = 4  # what asking a bucket costs, in rows of a scan
FIRST_ASKS = 512  # buckets that a query asks for in the first round
MOST_ASKS = 4096  # and in all, whatever the number of codes: so what is asked grows with the queries, not with their product
TASK_ROWS = 1 << 18  # asks that meet the index in one task
FOUND = "query_id long, row_id long, distance double"
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(column: pa.ChunkedArray, n: int, kind: type) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(n, -1)


def _least(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k least of each row of distances, ties by id."""
    if distance.shape[1] > k:
        edge = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero(distance <= edge)  # more than k where the k-th is tied
    else:
        q, r = (x.ravel() for x in np.indices(distance.shape))
    d, i = distance[q, r], ids[r]
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[first], i[first], d[first]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_top(rows: DataFrame, queries: DataFrame, k: int, distance: Distance, kind: type = np.float64, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, row_id, distance, rank) of the k nearest rows (row_id, v) of each of queries (query_id, v), v arrays of numbers.

    distance takes two matrices, a row for each vector, and gives the matrix of their distances."""
    rows, queries = rows.where("v is not null"), queries.where("v is not null")
    spread = rows.sparkSession.sparkContext.defaultParallelism
    n_rows, n_queries = rows.count(), queries.count()
    # No more blocks than bounded groups need, but enough for all cores.
    n_r, n_q = max(1, -(-n_rows // row_block), min(spread, n_rows // 512)), max(1, -(-n_queries // query_block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("query_id").cast("long"), "v", deal("query_id", n_q).alias("q")).withColumn("r", all_of(n_r))
    right = rows.select(F.col("row_id").cast("long"), "v", deal("row_id", n_r).alias("r")).withColumn("q", all_of(n_q))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if a.num_rows and b.num_rows:
            asked, ids = a["query_id"].to_numpy(), b["row_id"].to_numpy()
            x, y = _matrix(a["v"], len(asked), kind), _matrix(b["v"], len(ids), kind)
            step = max(1, CELLS // len(ids))
            for at in range(0, len(asked), step):
                q, i, d = _least(distance(x[at : at + step], y), ids, k)
                out.append((asked[at : at + step][q], i, d))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "row_id", "distance"])

    return _ranked(left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(search, FOUND), k)


def cosine_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus the cosine, to six places."""

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

    return -(np.round(unit(x) @ unit(y).T, 6) + 0.0)


def hamming_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Different bits of codes in 64-bit words."""
    return sum(np.bitwise_count(x[:, None, w] ^ y[None, :, w]).astype(np.float64) for w in range(x.shape[1]))


class Parts:
    """The parts of codes of so many bits, in words of 64 with the first bit highest."""

    def __init__(self, bits: int, codes: int) -> None:
        size = min(30, max(4, round(math.log2(max(codes, 2)))))
        self.n, self.words = -(-bits // size), -(-bits // 64)
        self.edges = [bits * p // self.n for p in range(self.n + 1)]

        self.longest = max(b - a for a, b in zip(self.edges, self.edges[1:]))

    def values(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code, a column for each part."""
        bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(len(codes), -1), axis=1)
        return np.stack([bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64)) for a, b in zip(self.edges, self.edges[1:])], axis=1)

    def flips(self, part: int, r: int) -> np.ndarray:
        """What to flip in a part for all values that differ in exactly r bits."""
        size = self.edges[part + 1] - self.edges[part]
        return np.array([sum(1 << i for i in c) for c in combinations(range(size), r)], np.int64)

    def asked(self, r: int) -> int:
        """The buckets that a query asks for at distance r."""
        return sum(math.comb(b - a, r) for a, b in zip(self.edges, self.edges[1:]))


def _bucketed(table: DataFrame, parts: Parts, radii: list[int], keep: str, schema: str) -> DataFrame:
    """A row (part, value, r, key, v) of table (key, v) for each bucket that its code v lies in or asks for."""

    def run(batches):
        for b in batches:
            codes = _matrix(pa.chunked_array([b.column(1)]), b.num_rows, np.int64).view(np.uint64) if b.num_rows else None
            for p in range(parts.n if b.num_rows else 0):
                own = parts.values(codes)[:, p]
                for r in radii:
                    flip = parts.flips(p, r)
                    for at in range(0, len(own), max(1, (1 << 18) // max(1, len(flip)))):
                        some = own[at : at + max(1, (1 << 18) // max(1, len(flip)))]
                        value, row = (some[:, None] ^ flip).ravel(), pa.array(np.repeat(np.arange(at, at + len(some)), len(flip)))
                        n = len(value)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(value), pa.array(np.full(n, r, np.int32)), b.column(0).take(row), b.column(1).take(row)], ["part", "value", "r", keep, "v"])

    return table.mapInArrow(run, f"part int, value long, r int, {schema}, v array<long>")


def _hot_buckets(index: DataFrame, hot: int) -> DataFrame | None:
    """(part, value, parts) of the buckets with more than hot codes, if there are any."""
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    sizes = written(sizes.select("part", "value", F.ceil(F.col("_n") / hot).cast("int").alias("_s")), "hamming-hot")
    return None if sizes.isEmpty() else sizes


def _salted(table: DataFrame, hot: DataFrame | None, each: bool) -> DataFrame:
    """table with salt: a hot bucket's codes are dealt out; who asks for it (each) asks all of its parts."""
    if hot is None:
        return table.withColumn("salt", F.lit(0))
    both, parts = table.join(hot, ["part", "value"], "left"), F.coalesce("_s", F.lit(1))
    return both.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)) if each else F.pmod(F.xxhash64("code"), parts).cast("int")).drop("_s")


def multi_index_top(rows: DataFrame, queries: DataFrame, k: int, bits: int, hot: int = 4096) -> DataFrame:
    """(query_id, row_id, distance, rank) of the k nearest rows (row_id, v), ids unique, of each of queries (query_id, v), v the words of codes of so many bits."""
    rows, each = rows.where("v is not null"), written(queries.where("v is not null").select(F.col("query_id").cast("long"), "v"), "hamming-queries")
    # Queries of one code have one answer.
    queries = written(each.groupBy("v").agg(F.min("query_id").alias("query_id")).select("query_id", "v"), "hamming-asked")
    w = W.partitionBy("v").orderBy("row_id")
    least = rows.select(F.col("row_id").cast("long"), "v").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    codes = written(least.groupBy("v").agg(F.sort_array(F.collect_list("row_id")).alias("ids")).withColumn("code", F.element_at("ids", 1)), "hamming-codes")
    n = codes.count()
    parts = Parts(bits, n)
    index = written(_bucketed(codes.select("code", "v"), parts, [0], "code", "code long").drop("r"), "hamming-index")
    sizes = _hot_buckets(index, hot)
    dealt = _salted(index, sizes, False)
    found, open_, r, asked = None, queries, 0, 0

    def answers(found: DataFrame) -> DataFrame:
        of = each.join(queries.withColumnRenamed("query_id", "_one"), "v").select("_one", "query_id")
        return found.withColumnRenamed("query_id", "_one").join(of, "_one").select("query_id", "row_id", "distance", "rank")

    def scanned(open_: DataFrame) -> DataFrame:
        # The k nearest rows are of the k nearest codes, ties by the least row.
        near = block_top(codes.select(F.col("code").alias("row_id"), "v"), open_, k, hamming_distance, np.uint64).withColumnRenamed("row_id", "code").drop("rank")
        return _ranked(near.join(codes.select("code", "ids"), "code").select("query_id", F.explode("ids").alias("row_id"), "distance"), k)

    while True:
        # The first radii together, while they ask little; then one at a time.
        radii = [r]
        while r == 0 and len(radii) <= parts.longest and sum(parts.asked(x) for x in [*radii, len(radii)]) <= FIRST_ASKS:
            radii.append(len(radii))
        now, n_open = sum(parts.asked(x) for x in radii), open_.count()
        asked += now
        if asked * PROBE > n or asked > MOST_ASKS or not n_open:
            break
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-max(n_open * now, n * parts.n) // TASK_ROWS))
        at = [F.col(c) for c in ("part", "value", "salt")]
        asks = _salted(_bucketed(open_, parts, radii, "query_id", "query_id long"), sizes, True)
        pairs = asks.withColumnRenamed("v", "asked").repartition(tasks, *at).join(dealt.repartition(tasks, *at), ["part", "value", "salt"]).select("query_id", "part", "r", "asked", "code", "v")
        new = pairs.mapInArrow(_once(parts), "query_id long, code long, distance double")
        new = new.join(codes.select("code", "ids"), "code").select("query_id", F.explode("ids").alias("row_id"), "distance")
        found = written(_ranked(new if found is None else new.unionByName(found.drop("rank")), k), "hamming-found")
        r = radii[-1]
        # All that differ in fewer bits than this have been met.
        if r >= parts.longest:  # every row differs in no more, so every row has been met
            return answers(found)
        sure = found.groupBy("query_id").agg(F.max("distance").alias("_far"), F.count("*").alias("_n")).where((F.col("_n") == k) & (F.col("_far") < parts.n * (r + 1)))
        open_ = written(open_.join(sure, "query_id", "left_anti"), "hamming-open")
        r += 1
    if found is None:
        return answers(scanned(open_))
    done = found.join(open_.select("query_id"), "query_id", "left_anti")
    if open_.isEmpty():
        return answers(done)
    return answers(done.unionByName(scanned(open_).select(done.columns)))


def _once(parts: Parts):
    """Pairs with their distances, each from the first of the parts in which they differ least: so no pair is met twice."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (_matrix(pa.chunked_array([b.column(b.schema.get_field_index(c))]), b.num_rows, np.int64).view(np.uint64) for c in ("asked", "v"))
                differ = np.unpackbits((x ^ y).astype(">u8").view(np.uint8).reshape(len(x), -1), axis=1)
                each = np.add.reduceat(differ[:, : parts.edges[-1]].astype(np.int64), parts.edges[:-1], axis=1)
                own = pa.array(each.argmin(1) == b.column(b.schema.get_field_index("part")).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("code")), pa.array(each.sum(1).astype(np.float64))], ["query_id", "code", "distance"]).filter(own)

    return run
