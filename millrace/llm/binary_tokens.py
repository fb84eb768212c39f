"""Operator 10: token ids in binary shards, compressed by Re-Pair grammars.

Documents are sorted by doc_id over range partitions; each partition writes shards of about SHARD ids. In a shard the most
frequent pair of neighbouring symbols becomes a nonterminal, counts are updated, and so on until no pair occurs LEAST times
without overlap, which is what its rule costs. A round takes all pairs that occur more than a sixteenth as often as the most
frequent one, each where it outranks the pairs that overlap it; counts are exact and taken anew after it, over the places whose pair
is still frequent. Rules and expansion lengths are stored, and the number of ids before every MARK-th symbol, so any range of ids
decodes without the rest. Shards are rows with a binary payload in Parquet files, so any store that Spark writes to will do.

Payload, little-endian: magic 'MRP2'; counts of documents, rules, symbols, the first nonterminal, bit planes (u32); doc_ids
(i64) and a null mask (u8); ids per document (u32); rules as pairs and then all symbols, each as their low 16 bits (u16) and
planes of their higher bits (packed); expansion lengths of the rules (u32); ids before every MARK-th symbol (u64).

Null texts are empty and hold the end id only; null doc_ids come first; equal doc_ids are in the order of a hash of their
texts, so a rerun gives the same places; very long texts are one document of a shard of their own size (under 2**32 ids); an empty
table gives no rows; extra columns are ignored."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import int_parts, slices, written
from millrace.llm.tokens import default_path, encoder

END = 2
SHARD = 1 << 18
LEAST = 5  # a rule of two 16-bit symbols and a length costs what four occurrences save
SHARE = 16  # a round takes the pairs of more than 1 / SHARE of the greatest count
MARK = 1024
MAGIC = b"MRP2"


def _by_pair(left: np.ndarray, right: np.ndarray, at: np.ndarray, symbols: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, first of each group): the places at with those of equal pairs together."""
    bits, low = symbols.bit_length(), places.bit_length()
    key = (left.astype(np.uint64) << np.uint64(bits)) | right
    if 2 * bits + low <= 64:  # place and pair in one number: a plain sort does it
        key <<= np.uint64(low)
        key |= at.astype(np.uint64)
        key.sort()
        at = (key & np.uint64((1 << low) - 1)).astype(np.intp)
        key >>= np.uint64(low)
    else:
        o = np.argsort(key, kind="stable")
        key, at = key[o], at[o]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return at, np.flatnonzero(new)


def re_pair(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules (n, 2)): the sequence and its rules when no pair occurs least times without overlap.

    The symbols are a linked list over the places of the ids; a round touches only places whose pair is still frequent. Where
    a round has joined many, the list is laid out anew."""
    n = len(ids)
    seq = np.append(ids, 0).astype(np.uint32)
    rules, made, live = [], 0, np.arange(max(n - 1, 0))
    after = None
    while len(live):
        if after is None:
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            before[0] = n  # the end is its own neighbour and never starts a pair
            rank, gone, near, joined = np.zeros(n + 1, np.int32), np.zeros(n + 1, bool), np.zeros(n + 1, bool), 0
        follower = live + 1 if not joined else after[live]
        at, first = _by_pair(seq[live], seq[follower], live, base + made, n)
        count = np.diff(np.append(first, len(at)))
        often = count >= least
        live = at[np.repeat(often, count)]
        if not len(live):
            break
        some = np.flatnonzero(often & (count > count.max() // SHARE))
        # Ranks order the round's pairs by count, then by symbols.
        by = some[np.lexsort((-some, count[some]))]
        rank_of = np.zeros(len(first), np.int32)
        rank_of[by] = np.arange(1, len(by) + 1)
        mine = np.repeat(rank_of, count)
        ranked = mine > 0
        place, mine = at[ranked], mine[ranked]
        rank[place] = mine
        # A run of one pair over itself (as in aaaa) is taken at every second place.
        even = np.ones(len(place), bool)
        head = at[first[by]]
        itself = np.append(False, seq[head] == seq[after[head]])
        if itself.any():
            twin = np.flatnonzero(itself[mine])
            twin = twin[np.argsort(place[twin])]
            head = np.append(True, (after[place[twin[:-1]]] != place[twin[1:]]) | (mine[twin[1:]] != mine[twin[:-1]]))
            even[twin] = (np.arange(len(twin)) - np.maximum.accumulate(np.where(head, np.arange(len(twin)), 0))) % 2 == 0
        if joined:
            pick = even & (rank[before[place]] <= mine) & (rank[after[place]] <= mine)
        else:
            top = rank[1:] <= rank[:-1]  # of each place's neighbour on its right
            pick = np.append(True, rank[:-1] <= rank[1:])[place]
            pick &= top[place]
            pick &= even
        rank[place] = 0
        taken = np.bincount(mine[pick], minlength=len(by) + 1)
        enough = taken >= least
        pick &= enough[mine]
        to = place[pick]
        if not len(to):  # overlaps alone make these so frequent
            alone = np.bincount(mine[even], minlength=len(by) + 1)
            live = live[~np.isin(live, place[alone[mine] < least])]
            continue
        used = np.flatnonzero(enough)
        used = used[used > 0][::-1]  # most frequent first
        number = np.zeros(len(by) + 1, np.uint32)
        number[used] = base + made + np.arange(len(used))
        where = at[first[by[used - 1]]]
        rules.append(np.stack([seq[where], seq[after[where]]], 1))
        made += len(used)
        seq[to] = number[mine[pick]]
        second = after[to]
        gone[second] = True
        joined += len(to)
        # The new symbols make pairs with both their neighbours.
        near[live] = near[to] = near[before[to]] = True
        if joined * 8 > n:
            near[:n] &= ~gone[:n]
            kept = np.flatnonzero(~gone[:n])
            n, after = len(kept), None
            live = np.flatnonzero(near[kept[:-1]])
            seq = np.append(seq[kept], np.uint32(0))
            continue
        after[to] = third = after[second]
        before[third] = to
        near[second] = False
        live = np.flatnonzero(near[:n])
        near[live] = False
        live = live[~gone[live] & (after[live] < n)]
    return seq[:n] if after is None else seq[:n][~gone[:n]], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1))
    return np.array(size, np.uint32)


def _sizes(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    size = np.ones(len(symbols), np.int64)
    big = symbols >= base
    size[big] = lengths[symbols[big] - base]
    return size


def expanded(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a run of symbols: each rule puts its two parts where they begin, level by level."""
    size = _sizes(symbols, lengths, base)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    at, now = ends - size, symbols
    while len(now):
        plain = now < base
        out[at[plain]] = now[plain]
        at = at[~plain]
        pair = rules[now[~plain] - base]
        at = np.concatenate([at, at + _sizes(pair[:, 0], lengths, base)])
        now = np.concatenate([pair[:, 0], pair[:, 1]])
    return out


def _planes(x: np.ndarray, planes: int) -> bytes:
    return (x & 0xFFFF).astype("<u2").tobytes() + b"".join(np.packbits((x >> (16 + k)) & 1 > 0, bitorder="little").tobytes() for k in range(planes))


def packed_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, base: int | None = None) -> bytes:
    """The payload; base is above every id (by default just above those of the shard)."""
    base = int(ids.max(initial=0)) + 1 if base is None else base
    if len(ids) and int(ids.max()) >= base:
        raise ValueError("an id is no terminal")
    symbols, rules = re_pair(ids, base)
    lengths, planes = expansion_lengths(rules, base), max(0, (base + len(rules)).bit_length() - 16)
    size = _sizes(symbols, lengths, base)
    marks = np.concatenate([[0], np.cumsum(size)])[:-1:MARK] if len(size) else np.zeros(0)
    return b"".join(
        (
            MAGIC, struct.pack("<5I", len(doc_ids), len(rules), len(symbols), base, planes),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array(counts, "<u4").tobytes(), _planes(rules.ravel(), planes), _planes(symbols, planes), lengths.astype("<u4").tobytes(), marks.astype("<u8").tobytes(),
        )
    )


class Shard:
    """A payload, opened: documents, their counts, and ids(start, n) of any range."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, symbols, self.base, planes = struct.unpack_from("<5I", payload, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        def whole(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for k in range(planes):
                out |= np.unpackbits(take("u1", -(-n // 8)), count=n, bitorder="little").astype(np.uint32) << np.uint32(16 + k)
            return out

        self.doc_ids, self.null, self.counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.rules, self.symbols, self.lengths = whole(2 * rules).reshape(-1, 2), whole(symbols), take("<u4", rules)
        self.marks = take("<u8", -(-symbols // MARK)).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Random access: only the symbols that cover the range are measured and unfolded."""
        if not n:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.marks, [start, start + n - 1], "right")
        some = self.symbols[(a - 1) * MARK : b * MARK]
        ends = self.marks[a - 1] + np.cumsum(_sizes(some, self.lengths, self.base))
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + n, "left"))
        before = int(ends[first - 1]) if first else int(self.marks[a - 1])
        return expanded(some[first : last + 1], self.rules, self.lengths, self.base)[start - before : start - before + n].astype("<u4")

    def all_ids(self) -> np.ndarray:
        return expanded(self.symbols, self.rules, self.lengths, self.base).astype("<u4")


def written_shards(docs: DataFrame, path: str | None = None, end: int = END, shard: int = SHARD) -> DataFrame:
    """The shard files of docs, read back: (part, seq, n_ids, payload), parts and seqs in ascending order of doc_id."""
    path = path or default_path()

    def made(batches):
        part, seq, coder = TaskContext.get().partitionId(), 0, encoder(path)
        base = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), *coder.tokenizer.get_vocab().values(), end) + 1
        names, counts, held, n, last = [], [], [], 0, np.array([end], np.uint32)

        def flush():
            nonlocal seq, names, counts, held, n
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([n], pa.int64()), "payload": pa.array([packed_shard(names, counts, np.concatenate(held), base)], pa.binary())})
            seq, names, counts, held, n = seq + 1, [], [], [], 0
            return row

        for some, buf, offs in slices(batches, "_text"):
            for doc, ids in zip(some.column(0).to_pylist(), coder.ids_of(buf, offs)):
                names.append(doc)
                counts.append(len(ids) + 1)
                held += (ids, last)
                n += len(ids) + 1
                if n >= shard:
                    yield flush()
        if names:
            yield flush()

    # Rows of one doc_id are ordered and dealt out by a hash of their text.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    rows = rows.repartitionByRange(int_parts(docs.sparkSession), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").select("doc_id", "_text")
    return written(rows.mapInArrow(made, "part int, seq int, n_ids long, payload binary"), "token-shards")


def read_back(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_sum"))
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("_sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    first = shards.select("part", "seq", "n_ids").withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    first = first.join(parts, F.col("part") == F.col("_p")).select("part", "seq", (F.col("_in") + F.col("_before")).alias("first"))

    def decoded(batches):
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = Shard(payload)
                ids, ends = s.all_ids(), np.cumsum(s.counts, dtype=np.int64)
                crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends.tolist(), s.counts.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(s.doc_ids, pa.int64(), mask=s.null.astype(bool)), pa.array(ends - s.counts), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "payload").mapInArrow(decoded, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def binary_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_back(written_shards(docs, path))
