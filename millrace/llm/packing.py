"""Operator 3: best-fit packing.

Best-fit decreasing needs only the lengths. Their histogram has at most one row for each length up to the capacity, so
it is the one thing the driver gets; there bins are placed in runs of equal state, and a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time. The plan, runs of (length, ranks) to (bins, offset), goes
back to the executors, where each piece finds its place by its rank among the pieces of its length. The result is that
of best-fit decreasing over all pieces one by one, at any number of partitions.

Null texts are empty and give one piece with the end id only; a document's own id may be null or repeated (its rows are
placed one by one); texts of any length are encoded whole and cut into pieces; an empty table gives no rows; extra columns
are ignored."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import slices, written
from millrace.llm.tokens import default_path, encoder

CAPACITY = 2048
END = 0


class Tightest:
    """A segment tree over remaining capacities 0..most: the number of open bins of each, and the least one from a bound."""

    def __init__(self, most: int) -> None:
        self.n = 1 << most.bit_length()
        self.open = [0] * (2 * self.n)

    def put(self, capacity: int, bins: int) -> None:
        i = capacity + self.n
        while i:
            self.open[i] += bins
            i //= 2

    def least_from(self, low: int) -> int | None:
        """The least capacity >= low of an open bin."""
        i = low + self.n
        if self.open[i]:
            return low
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: runs (length, first rank, end rank, first bin, pieces a bin, offset).

    Piece r of a run lies in bin first + (r - first rank) // a_bin at offset + (r - first rank) % a_bin * length. An open
    bin that has just taken a piece stays the tightest while it has room, so a bin is filled before the next is touched."""
    tree, runs = Tightest(capacity), []
    opened: dict[int, list[list[int]]] = defaultdict(list)  # remaining capacity -> [first bin, bins]
    bins = 0

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            tree.put(remaining, n)
            if opened[remaining] and sum(opened[remaining][-1]) == first:
                opened[remaining][-1][1] += n
            else:
                opened[remaining].append([first, n])

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.least_from(length)
            if room is None:
                room, first, n = capacity, bins, count
                n = min(n, -(-(count - rank) // (room // length)))
                bins += n
            else:
                first, n = opened[room][-1]
                take = min(n, -(-(count - rank) // (room // length)))
                first, n = first + n - take, take
                opened[room][-1][1] -= take
                if not opened[room][-1][1]:
                    opened[room].pop()
                tree.put(room, -take)
            each = room // length
            end = min(count, rank + n * each)
            runs.append((length, rank, end, first, each, capacity - room))
            part = (end - rank) % each
            leave(room - each * length, first, n - (1 if part else 0))
            if part:
                leave(room - part * length, first + n - 1, 1)
            rank = end
    return runs


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id; only longer ones are cut, the first piece may be shorter."""
    path = path or default_path()

    def cut(batches):
        ids_of = encoder(path)
        for some, buf, offs in slices(batches, "_text"):
            out = []
            for doc, ids in zip(some.column(0).to_pylist(), ids_of.ids_of(buf, offs)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                n, at, k = len(ids) % capacity or capacity, 0, 0
                while at < len(ids):
                    out.append((doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at, k, n = at + n, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(table: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """table (written, with a column length of 1..capacity) with sequence_id and offset.

    The rank of a row among those of its length: its rank within (length, salt) and the rows of the salts before; no
    length is ranked in one task."""
    spark = table.sparkSession
    keys = [c for c in table.columns if c != "length"]
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counts = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    runs = defaultdict(list)
    for r in best_fit_runs(histogram, capacity):
        runs[r[0]].append(r[1:])
    plan = spark.createDataFrame(sorted(runs.items()), "_length long, _runs array<struct<low:long,high:long,first:long,each:long,at:long>>")
    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*[F.col(k) for k in keys])) - 1
    ranked = salted.withColumn("_r", rank).join(counts.select("length", "_salt", "_before"), ["length", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    # The plan has a bounded size: at most capacity lengths, with runs of equal state.
    placed = ranked.join(F.broadcast(plan), F.col("length") == F.col("_length"))
    placed = placed.withColumn("_run", F.get(F.filter("_runs", lambda x: (x["low"] <= F.col("_rank")) & (F.col("_rank") < x["high"])), F.lit(0)))
    nth = F.col("_rank") - F.col("_run.low")
    return placed.select(
        *table.columns,
        (F.col("_run.first") + F.floor(nth / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.at") + (nth % F.col("_run.each")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The query's columns: every piece of docs and its place."""
    return packed(written(pieces(docs, path, capacity, end), "pack-pieces"), capacity)
