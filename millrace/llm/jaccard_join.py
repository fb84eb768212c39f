"""Operator 6: exact set-similarity join on word shingles by vertical partitioning.

1. Every text becomes the set of its 5-word shingles (64-bit hashes). Texts with equal sets are one node (the hash of the
   set), so copies are never paired. Counts of the shingles in ORDER_SLOTS hash slots (a fixed size), over all texts, fix
   one global order, frequent ones last: what a hot passage brings stays out of nearly all prefixes. Any order is exact.
2. Each set sends its prefix in that order, and sets that share a prefix shingle may be similar. A shingle at position
   i of a set of n leaves at most n - i common ones, so it bounds the size of a partner; postings without a possible
   partner go. A first round pairs each group's most central member with the others; a second one pairs what is left
   between components, so a group of near copies never becomes all its pairs.
3. Pairs are verified over vertical fragments: the order of shingle hashes is cut into FRAGMENTS ranges, partial overlaps
   are counted for each fragment on its own and summed per pair; the sets of a hot member are dealt out by a salt.
4. Components of the links by large-star / small-star rounds.

Only sets that a fixed-size Bloom filter of the paired nodes lets through are sent for step 3 (false hits cost bytes, not
results). Null texts and texts without words have no shingles and are linked with nothing; null doc_ids are carried and
never the least; repeated rows are copies; texts of any length are shingled whole; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import carried, content_hash, int_parts, slices, trim, written
from millrace.llm.components import components

SHINGLE = 5
PERCENT = 80
FRAGMENTS = 8
ORDER_BITS = 22
ORDER_SLOTS = 1 << ORDER_BITS
_SLOT = np.uint64(64 - ORDER_BITS)
CHUNK = 1 << 16
FILTER_BITS = 1 << 25
FILTER_PARTS = 256
SALTS = 16
SLICE = 1 << 19


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ends): the sorted set of each text, laid end to end."""
    low = K.LOWER[buf]
    starts, ends, owner = K.words(low, offs)
    h = K.span_hashes(K.prefix(low), starts, ends)
    n = len(offs) - 1
    count = np.bincount(owner, minlength=n)

    def chained(first: np.ndarray, k: int) -> np.ndarray:
        g = K.mixed(h[first] * np.uint64(0x9E3779B97F4A7C15))
        for i in range(1, k):
            g = K.mixed(g + h[first + i])
        return g

    gram = np.flatnonzero(owner[: len(h) - size + 1] == owner[size - 1 :]) if len(h) >= size else np.zeros(0, np.int64)
    hashes, texts = [chained(gram, size)], [owner[gram]]
    heads = np.cumsum(count) - count
    for k in range(1, size):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(count == k)
        hashes.append(chained(heads[short], k) + np.uint64(k))
        texts.append(short)
    g, t = np.concatenate(hashes), np.concatenate(texts)
    order = np.lexsort((g, t))
    g, t = g[order], t[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    g, t = g[keep], t[keep]
    return g, np.searchsorted(t, np.arange(n), "right")


def node_ids(g: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each sorted set, as signed 64-bit integers."""
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(g)) - np.repeat(starts, ends - starts)
    part = K.mixed(g + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    return K.mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


_DIGEST = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("counts", pa.binary())])


def digest(docs: DataFrame) -> DataFrame:
    """Written rows of kind 0: (doc_id, n, node) of each text; of kind 1: a task's slot counts (chunk in n)."""

    def run(batches):
        slots = np.zeros(ORDER_SLOTS, np.int32)
        for batch, buf, offs in slices(batches, "_text", SLICE):
            g, ends = shingle_sets(buf, offs)
            np.add.at(slots, (g >> _SLOT).astype(np.int64), np.int32(1))
            m = batch.num_rows
            yield _batch(_DIGEST, [np.zeros(m, np.int32), batch.column(0), np.diff(ends, prepend=0), node_ids(g, ends), [None] * m])
        # One byte a slot: above 255 in one task, more makes no difference to the order.
        rows = [(1, None, k, None, np.minimum(slots[k * CHUNK : (k + 1) * CHUNK], 255).astype(np.uint8).tobytes()) for k in range(ORDER_SLOTS // CHUNK)]
        if slots.any():
            yield _batch(_DIGEST, list(zip(*rows)))

    return written(docs.mapInArrow(run, "kind int, doc_id long, n long, node long, counts binary"), "jac-digest")


def slot_counts(digests: DataFrame) -> np.ndarray:
    """The summed counts of all slots: ORDER_SLOTS numbers, whatever the input."""

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64)
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([c.astype("<i8").tobytes()], pa.binary())], ["k", "c"])

    out = np.zeros((ORDER_SLOTS // CHUNK, CHUNK), np.int64)
    for r in digests.where("kind = 1").select("n", "counts").repartition(ORDER_SLOTS // CHUNK, "n").mapInArrow(summed, "k long, c binary").toLocalIterator():
        out[r["k"]] += np.frombuffer(r["c"], "<i8")
    return out.ravel()


def postings(docs: DataFrame, order: np.ndarray, percent: int, parts: int) -> DataFrame:
    """The prefix of each node in the global order, packed by bucket of the shingle: nodes, sizes, runs, shingles, positions."""
    shared = docs.sparkSession.sparkContext.broadcast(order.astype(np.uint32))

    def run(batches):
        rank, seen = shared.value, set()
        for _, buf, offs in slices(batches, "_text", SLICE):
            g, ends = shingle_sets(buf, offs)
            nodes, starts = node_ids(g, ends), np.concatenate([[0], ends[:-1]])
            n = ends - starts
            if len(seen) > 1 << 20:
                seen.clear()
            fresh = []
            for i in np.flatnonzero(n).tolist():
                if (x := int(nodes[i])) not in seen:
                    seen.add(x)
                    fresh.append(i)
            if not fresh:
                continue
            t = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((g, rank[(g >> _SLOT).astype(np.int64)], t))
            g, place = g[by], np.arange(len(g)) - starts[t]
            prefix = n - -(-percent * n // 100) + 1
            ok = np.zeros(len(n), bool)
            ok[fresh] = True
            keep = (place < prefix[t]) & ok[t]
            g, t, place = g[keep], t[keep], place[keep]
            bucket = ((g >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            o = np.lexsort((t, bucket))
            g, t, place, bucket = g[o], t[o], np.minimum(place[o], 65535).astype("<u2"), bucket[o]
            edges = np.searchsorted(bucket, np.arange(parts + 1))
            rows = []
            for b in range(parts):
                lo, hi = edges[b], edges[b + 1]
                if lo < hi:
                    own, runs = np.unique(t[lo:hi], return_counts=True)
                    rows.append((b, nodes[own].astype("<i8").tobytes(), n[own].astype("<u4").tobytes(), runs.astype("<u4").tobytes(), g[lo:hi].astype("<u8").tobytes(), place[lo:hi].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], ["bucket", "nodes", "sizes", "runs", "tokens", "places"])

    return docs.mapInArrow(run, "bucket int, nodes binary, sizes binary, runs binary, tokens binary, places binary")


def _edges_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def groups_of(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int):
    """The postings that may have a partner, sorted by shingle and size: (token, node, n, most), most: the largest partner.

    A pair links only with an overlap of at least percent / (100 + percent) of both sizes together, and from position i on
    at most n - i can be common."""
    o = np.lexsort((node, n, token))
    token, node, n, place = token[o], node[o], n[o].astype(np.int64), place[o]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n, place = token[keep], node[keep], n[keep], place[keep]
    most = (n - place) * (100 + percent) // percent - n
    while len(token):
        first, length = _edges_of(token)
        keep = (most >= np.repeat(n[first], length)) & np.repeat(length > 1, length)
        if keep.all():
            break
        token, node, n, most = token[keep], node[keep], n[keep], most[keep]
    return token, node, n, most


def _pairs_schema() -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("blob", pa.binary())])


def first_round(sent: DataFrame, percent: int, parts: int) -> DataFrame:
    """Written rows of kind 0: pairs (a, b); of kind 1: a packed group table for the second round."""

    def run(batches):
        held = [[] for _ in range(4)]
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(1, 6))):
                nodes, sizes, runs, tokens, places = (np.frombuffer(x.as_buffer(), k) for x, k in zip(row, ("<i8", "<u4", "<u4", "<u8", "<u2")))
                for h, x in zip(held, (tokens, np.repeat(nodes, runs), np.repeat(sizes, runs), places)):
                    h.append(x)
        if not held[0]:
            return
        token, node, n, most = groups_of(*(np.concatenate(h) for h in held), percent)
        if not len(token):
            return
        first, length = _edges_of(token)
        group = np.repeat(np.arange(len(first)), length)
        # The most central member has the most room for a partner: its common shingles come first.
        room = np.lexsort((node, most - n, group))
        x, y = np.repeat(room[first + length - 1], length), np.arange(len(token))
        ok = (node[x] != node[y]) & (n[y] <= most[x]) & (n[x] <= most[y])
        a, b = np.minimum(node[x], node[y])[ok], np.maximum(node[x], node[y])[ok]
        o = np.lexsort((b, a))
        a, b = a[o], b[o]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[keep], b[keep]
        yield _batch(_pairs_schema(), [np.zeros(len(a), np.int32), a, b, [None] * len(a)])
        blob = np.stack([token.view(np.int64), node, n, most], 1).astype("<i8")
        for k in range(0, len(blob), 50_000):
            yield _batch(_pairs_schema(), [[1], [None], [None], [blob[k : k + 50_000].tobytes()]])
        held = token = node = n = most = blob = None
        trim()

    return written(sent.repartition(parts, "bucket").mapInArrow(run, "kind int, a long, b long, blob binary"), "jac-groups")


def _filter_bits(node: np.ndarray) -> list[np.ndarray]:
    h = K.mixed(node.view(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return [((h >> np.uint64(8 * k)) ^ (h << np.uint64(11 * k + 3))) % np.uint64(FILTER_BITS // FILTER_PARTS) for k in range(3)]


def _filter_part(node: np.ndarray) -> np.ndarray:
    return (K.mixed(node.view(np.uint64)) >> np.uint64(56)).astype(np.int64)


def node_filter(pairs: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes of pairs (a, b): FILTER_BITS bits whatever the input, made in parts on the executors."""

    def by_part(batches):
        for batch in batches:
            node = np.unique(np.concatenate([c.to_numpy() for c in batch.columns]))
            part = _filter_part(node)
            o = np.argsort(part, kind="stable")
            node, part = node[o], part[o]
            first, length = _edges_of(part)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array([node[f : f + k].tobytes() for f, k in zip(first, length)], pa.binary())], ["part", "nodes"])

    def made(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                bits = parts.setdefault(p, np.zeros(FILTER_BITS // FILTER_PARTS, bool))
                for b in _filter_bits(np.frombuffer(x.as_buffer(), "<i8")):
                    bits[b.astype(np.int64)] = True
        for p, bits in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros((FILTER_PARTS, FILTER_BITS // FILTER_PARTS // 8), np.uint8)
    sent = pairs.select("a", "b").mapInArrow(by_part, "part int, nodes binary").repartition(16, "part")
    for r in sent.mapInArrow(made, "part int, bits binary").toLocalIterator():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out


def paired_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, kind 0, frag, blob): the sets of the nodes of pairs, cut into fragments of the order of hashes.

    The filter's false hits send sets that nobody asks for."""
    shared = docs.sparkSession.sparkContext.broadcast(node_filter(pairs))
    cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)).astype(np.uint64)

    def run(batches):
        have, seen = shared.value, set()
        for _, buf, offs in slices(batches, "_text", SLICE):
            g, ends = shingle_sets(buf, offs)
            nodes, starts = node_ids(g, ends), np.concatenate([[0], ends[:-1]])
            part, hit = _filter_part(nodes), ends > starts
            for b in _filter_bits(nodes):
                hit &= (have[part, (b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
            rows = []
            for i in np.flatnonzero(hit).tolist():
                x = int(nodes[i])
                if x in seen:
                    continue
                seen.add(x)
                s = g[starts[i] : ends[i]]
                at = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
                rows += [(x, f, s[at[f] : at[f + 1]].tobytes()) for f in range(FRAGMENTS)]
            if rows:
                a, f, blob = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([0] * len(a), pa.int32()), pa.array(f, pa.int32()), pa.array(blob, pa.binary())], ["node", "kind", "frag", "blob"])

    return docs.mapInArrow(run, "node long, kind int, frag int, blob binary")


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps of each fragment, counted separately and summed per pair."""
    sets, parts = paired_sets(docs, pairs), int_parts(docs.sparkSession)
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    null = F.lit(None)
    salted = pairs.select("a", "b", salt.alias("salt"))
    asks = salted.select(F.col("a").alias("node"), F.lit(1).alias("kind"), F.col("salt").alias("frag"), null.cast("binary").alias("blob"), null.cast("long").alias("a")).distinct()
    asks = asks.union(salted.select(F.col("b").alias("node"), F.lit(2).alias("kind"), F.col("salt").alias("frag"), null.cast("binary").alias("blob"), "a"))
    send = pa.schema([("a", pa.int64()), ("salt", pa.int32()), ("frag", pa.int32()), ("kind", pa.int32()), ("b", pa.int64()), ("blob", pa.binary())])

    def dealt(batches):
        node, own, rows, size = None, {}, [], 0
        for batch in batches:
            blobs = batch.column(3)
            for k, (x, kind, frag, a) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))):
                if x != node:
                    node, own = x, {}
                if kind == 0:
                    own[frag] = blobs[k].as_py()  # copies of a text bring the same set
                    continue
                rows += [(x, frag, f, 0, None, s) for f, s in own.items()] if kind == 1 else [(a, frag, f, 1, x, s) for f, s in own.items()]
                size += sum(map(len, own.values()))
                if size > 1 << 22:
                    yield _batch(send, list(zip(*rows)))
                    rows, size = [], 0
        if rows:
            yield _batch(send, list(zip(*rows)))

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])

    def counted(batches):
        key, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            blobs = batch.column(5)
            for k, (a, s, f, kind, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                x = np.frombuffer(blobs[k].as_buffer(), "<u8")
                if (a, s, f) != key:
                    key, own = (a, s, f), np.zeros(0, np.uint64)
                if kind == 0:
                    own = x.copy()  # it outlives its batch
                elif len(own) and len(x):
                    i = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    rows.append((a, b, int((own[i] == x).sum()), len(own) + len(x)))
                else:
                    rows.append((a, b, 0, len(own) + len(x)))
            if rows:
                yield _batch(out, list(zip(*rows)))

    given = sets.withColumn("a", null.cast("long")).union(asks).repartition(parts, "node").sortWithinPartitions("node", "kind")
    blobs = given.mapInArrow(dealt, "a long, salt int, frag int, kind int, b long, blob binary")
    partial = blobs.repartition(parts, "a", "salt", "frag").sortWithinPartitions("a", "salt", "frag", "kind").mapInArrow(counted, "a long, b long, common long, total long")
    sums = partial.groupBy("a", "b").agg(F.sum("common").alias("c"), F.sum("total").alias("t"))
    return sums.where(100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("a", "b")


def second_round(groups: DataFrame, roots: DataFrame, done: DataFrame, parts: int) -> DataFrame:
    """The pairs of the groups between different components that the first round didn't verify."""
    rows = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("most", pa.int64())])

    def opened(batches):
        for batch in batches:
            for x in batch.column(0):
                yield _batch(rows, list(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 4).T))

    kind = "token long, node long, n long, most long"
    members = groups.where("kind = 1").select("blob").mapInArrow(opened, kind).join(roots, "node", "left").select("token", "node", "n", "most", F.coalesce("root", "node").alias("root"))
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def crossed(batches):
        held, kept = [], []

        def pairs(table):
            table = table[np.lexsort((table[:, 1], table[:, 2], table[:, 0]))]
            first, length = _edges_of(table[:, 0])
            for f, k in zip(first.tolist(), length.tolist()):
                _, node, n, most, root = table[f : f + k].T
                if k < 2 or (root == root[0]).all():
                    continue
                reach = np.searchsorted(n, most, "right")  # sorted by size: the partners are a range
                for i in range(k - 1):
                    j = np.arange(i + 1, max(reach[i], i + 1))
                    j = j[(most[j] >= n[i]) & (root[j] != root[i])]
                    if len(j):
                        yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            held.append(table)
            whole = np.concatenate(held)
            cut = int(np.searchsorted(whole[:, 0], whole[-1, 0]))  # the last group may go on
            kept.extend(pairs(whole[:cut]))
            held = [whole[cut:]]
        if held and len(held[0]):
            kept.extend(pairs(held[0]))
        if kept:
            a, b = (np.concatenate(x) for x in zip(*kept))
            both = np.unique(np.stack([a, b], 1), axis=0)
            yield _batch(pair, [both[:, 0], both[:, 1]])

    found = members.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(crossed, "a long, b long").distinct()
    return found.join(done, ["a", "b"], "left_anti")


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = int_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    texts = rows.select("_text")
    digests = digest(rows)
    order = slot_counts(digests)
    groups = first_round(postings(texts, order, percent, parts), percent, parts)
    pairs = written(groups.where("kind = 0").select("a", "b").distinct(), "jac-pairs")
    links = written(verified(texts, pairs, percent), "jac-links")
    roots = written(components(links), "jac-roots")
    more = written(verified(texts, written(second_round(groups, roots, pairs, parts), "jac-pairs2"), percent), "jac-links2")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    own = digests.where("kind = 0").select("doc_id", "n", "node")
    # One row a node before anything is joined: copies don't weigh.
    nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("_least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_node = nodes.join(least, "root").select("node", "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.where("n > 0").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; of rows with equal doc_id and text the one with
    the least hash of all its columns."""
    kept = similar_documents(docs.select("doc_id", "text"), percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    out = docs.select(carried(docs)).join(kept, F.col("_doc.doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    first = W.partitionBy("_doc.doc_id", F.xxhash64("_doc.text")).orderBy(content_hash(docs.schema, 6, "_doc"))
    return out.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
