"""Operator 1: repeated substrings by prefix-free parsing.

A byte goes if a 200-byte string that covers it also starts anywhere else. Every start of such a string belongs to one
anchor: the position, inside the string, of the least rolling hash of GRAM bytes (the leftmost of equals). It depends on
the string only, so equal strings have anchors with equal bytes at equal distances.

1. Each text (copies of a text count as one, and are removed whole) sends the hashes of its anchors to where they are
   compared; those met once are done with. A fixed-size Bloom filter of the others lets candidates through (false hits
   cost bytes, not results).
2. The candidates' surroundings (all strings of an anchor, some 270 bytes) meet by hash. Equal ones met twice are repeats.
   Different ones around equal anchors form a small, highly repetitive corpus, which is parsed prefix-free: rolling-hash
   triggers cut it into phrases; the suffix array of the dictionary and that of the parse, by doubling, combine into the
   corpus order of all string starts, where repeats are neighbours. Neighbours are compared byte by byte.
3. The ranges go to their texts; texts that no range reached never move.

Hot groups: of equal surroundings a task sends two, which is enough to know all of them as repeats; the others' ranges go
straight to their texts. Anchors that more than HOT texts or places have send a 128-bit digest of each of their strings
instead of the surroundings, so their strings are dealt out over all buckets; equal digests are repeats.

Null texts are empty; null doc_ids are carried; repeated rows are copies; texts under 200 bytes stay whole; very long texts
are read in overlapping segments; an empty table
gives no rows; extra columns are ignored by the digest and carried by deduplicated()."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import carried, int_parts, slices, trim, written

WINDOW = 200
GRAM = 64
TRIGGER = 8  # bytes of the parse's rolling window
PERIOD = 32  # a trigger in so many bytes
SLICE = 1 << 20
SEGMENT = 1 << 25  # bytes of a longer text at a time; twice that fits in PLACE
FILTER_BITS = 1 << 26
FILTER_PARTS = 256
PLACE = np.uint64(28)  # low bits of a key that hold a position
HOT = 20_000
_DIGEST = 0xFFFFFFFF  # in a post's anchor: the post is one string's digest
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def anchors(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM, segment: int = SEGMENT):
    """(text, low, high, anchor, hash, around): of each anchor its text, the first and last start that it serves, its position
    (all in the slice), the hash of its bytes and that of its surroundings, all strings that it serves.

    A text longer than a segment is cut into overlapping ones, so arrays and positions have a bounded size."""
    n, span = len(buf), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if n > segment and len(offs) == 2:
        out = []
        for at in range(0, n - window + 1, segment):
            part = buf[at : at + segment + window - 1]
            text, low, high, place, h, e = anchors(part, np.array([0, len(part)]), window, gram, 2 * segment)
            out.append((text, low + at, high + at, place + at, h, e))
        return tuple(np.concatenate(x) for x in zip(*out))
    sums = K.prefix(buf)
    at = np.arange(n - gram + 1)
    h = K.span_hashes(sums, at, at + gram)
    least = (h >> PLACE << PLACE) | at.astype(np.uint64)
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    lengths = np.diff(offs)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + window <= offs[text + 1])
    place = (least[start] & np.uint64((1 << 28) - 1)).astype(np.int64)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    text = text[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    low, high, place = start[first], start[last], place[first]
    around = K.mixed(K.span_hashes(sums, low, high + window) + (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (high - low).astype(np.uint64))
    return text[first], low, high, place, h[place], around


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit keys, or of (key, small) pairs."""
    r = np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    for k in keys[1:]:
        r = np.unique((r << np.uint64(32)) | k.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return r


def _doubled(rank: np.ndarray, ends: np.ndarray, mark: np.ndarray, step: int, most: int) -> np.ndarray:
    """Ranks of the suffixes that stop at ends, from ranks of their first step symbols; mark: 0 or 1 beyond the end."""
    at = np.arange(len(rank))
    while step < most:
        inside = at + step < ends
        then = mark.astype(np.uint64)
        then[inside] = rank[at[inside] + step] + np.uint64(2)
        rank = _ranked(rank, then)
        step *= 2
    return rank


def repeated_starts(texts: list[bytes], starts: np.ndarray, window: int = WINDOW, period: int = PERIOD) -> np.ndarray:
    """For the first starts[i] positions of each text, laid end to end: whether the window-byte string there is also
    at another of these positions. By prefix-free parsing."""
    buf = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    owner = np.repeat(np.arange(len(texts)), lengths)
    eight = np.ndarray((n,), ">u8", buf, strides=(1,)).astype(np.uint64)

    # The parse: phrases from trigger to trigger, each with the next trigger's bytes; the last of a text ends with it.
    cut = (K.mixed(eight) & np.uint64(period - 1)) == 0
    cut &= np.arange(n) + TRIGGER < ends[owner]
    cut[ends - lengths] = True
    begin = np.flatnonzero(cut)
    of = owner[begin]
    final = np.ones(len(begin), bool)
    final[:-1] = of[1:] != of[:-1]
    stop = np.where(final, ends[of], np.append(begin[1:], n) + TRIGGER)
    stop = np.minimum(stop, ends[of])
    sums = K.prefix(buf[:n])
    name = K.mixed(K.span_hashes(sums, begin, stop) + (stop - begin).astype(np.uint64) * np.uint64(2) + final)
    _, kept, phrase = np.unique(name, return_index=True, return_inverse=True)

    # The dictionary's suffix array: ranks of all suffixes of its phrases.
    size = (stop - begin)[kept]
    first = np.cumsum(size) - size
    place = np.repeat(begin[kept] - first, size) + np.arange(int(size.sum()))
    end = np.repeat(first + size, size)
    last = np.repeat(final[kept], size)
    left = end - np.arange(len(place))
    short = np.minimum(left, 8)
    mask = ~np.uint64(0) << (np.uint64(8) * (8 - np.maximum(short, 1)).astype(np.uint64))
    rank = _ranked(eight[place] & mask, short * 2 + (last & (left < 8)))
    rank = _doubled(rank, end, last, 8, int(size.max()))

    # The parse's suffix array: the phrases' ranks, doubled along each text.
    follow = _ranked(rank[first][phrase])
    tail = np.searchsorted(of, of, "right")
    follow = _doubled(follow, tail, np.zeros(len(begin)), 1, int(np.bincount(of).max()))

    # Corpus order of the starts: the rank of what is left of their phrase, then of the parse behind it.
    begun = ends - lengths
    at = np.repeat(begun - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    j = np.searchsorted(begin, at, "right") - 1
    behind = np.zeros(len(begin), np.uint64)
    behind[:-1] = np.where(final[:-1], np.uint64(0), follow[1:] + np.uint64(1))
    order = np.argsort((rank[first[phrase[j]] + at - begin[j]] << np.uint64(32)) | behind[j])
    flag = np.zeros(len(at), bool)
    if window % 8 == 0:
        rows = np.ndarray((n - window + 1, window // 8), "<u8", buf, strides=(1, 8))
    else:
        rows = np.ndarray((n - window + 1, window), np.uint8, buf, strides=(1, 1))
    for k in range(0, len(order) - 1, 32_768):
        a, b = order[k : k + 32_768], order[k + 1 : k + 32_769]
        a = a[: len(b)]
        same = (rows[at[a]] == rows[at[b]]).all(1)
        flag[a[same]] = True
        flag[b[same]] = True
    return flag


def string_digests(text: bytes, low: int, high: int, window: int = WINDOW) -> np.ndarray:
    """Two 64-bit halves of the digest of each window-byte string that starts from low to high."""
    view = memoryview(text)
    return np.frombuffer(b"".join(hashlib.blake2b(view[i : i + window], digest_size=16).digest() for i in range(low, high + 1)), "<u8").reshape(-1, 2)


def text_nodes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(node id, sha256) of each text."""
    view = buf.tobytes()
    digests = [hashlib.sha256(view[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return np.frombuffer(b"".join(d.digest()[:8] for d in digests), "<i8"), [d.hexdigest() for d in digests]


def _fresh(nodes: np.ndarray, seen: set) -> np.ndarray:
    """Which texts of a slice the task hasn't met."""
    if len(seen) > 1 << 20:
        seen.clear()
    out = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)


def _record(names: list[str], kinds: list, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def digest(docs: DataFrame, parts: int, window: int, gram: int) -> DataFrame:
    """Written rows: of kind 0 (doc_id, node, n_bytes, sha256) of each text; of kind 1 anchor hashes with their nodes, by bucket (in n_bytes)."""
    names = ["kind", "doc_id", "node", "n_bytes", "sha", "h", "owner"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        seen: set = set()
        for batch, buf, offs in slices(batches, "_text", SLICE):
            nodes, shas = text_nodes(buf, offs)
            m = batch.num_rows
            none = pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), batch.column(0), pa.array(nodes), pa.array(np.diff(offs)), pa.array(shas), none, none], names)
            text, _, _, _, h, _ = anchors(buf, offs, window, gram)
            keep = _fresh(nodes, seen)[text] if len(text) else np.zeros(0, bool)
            own, h = nodes[text[keep]], h[keep]
            o = np.lexsort((own, h))
            own, h = own[o], h[o]
            # A text that holds an anchor twice stands for two.
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            own = np.where(again, ~own, own)
            b = _bucket(h, parts)
            o = np.argsort(b, kind="stable")
            own, h, b = own[o], h[o], b[o]
            edges = np.searchsorted(b, np.arange(parts + 1))
            rows = [(1, None, None, k, None, h[edges[k] : edges[k + 1]].tobytes(), own[edges[k] : edges[k + 1]].tobytes()) for k in range(parts) if edges[k] < edges[k + 1]]
            if rows:
                yield _record(names, kinds, rows)

    return written(docs.mapInArrow(run, "kind int, doc_id long, node long, n_bytes long, sha string, h binary, owner binary"), "sa-digest")


def _bits(h: np.ndarray) -> list[np.ndarray]:
    a = K.mixed(h + np.uint64(0x632BE59BD9B4E019))
    size = np.uint64(FILTER_BITS // FILTER_PARTS - 1)
    return [(a & size).astype(np.int64), ((a >> np.uint64(24)) & size).astype(np.int64)]


def _part(h: np.ndarray) -> np.ndarray:
    return (K.mixed(h) >> np.uint64(56)).astype(np.int64)


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter of the 64-bit hashes in the binary column h; its parts are made on the executors, its size is fixed."""

    def by_part(batches):
        for batch in batches:
            for x in batch.column(0):
                h = np.frombuffer(x.as_buffer(), "<u8")
                part = _part(h)
                o = np.argsort(part, kind="stable")
                h, part = h[o], part[o]
                edges = np.searchsorted(part, np.arange(FILTER_PARTS + 1))
                rows = [(p, h[edges[p] : edges[p + 1]].tobytes()) for p in range(FILTER_PARTS) if edges[p] < edges[p + 1]]
                if rows:
                    yield _record(["part", "h"], [pa.int32(), pa.binary()], rows)

    def made(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                have = parts.setdefault(p, np.zeros(FILTER_BITS // FILTER_PARTS, bool))
                for b in _bits(np.frombuffer(x.as_buffer(), "<u8")):
                    have[b] = True
        for p, have in parts.items():
            yield _record(["part", "bits"], [pa.int32(), pa.binary()], [(p, np.packbits(have, bitorder="little").tobytes())])

    out = np.zeros((FILTER_PARTS, FILTER_BITS // FILTER_PARTS // 8), np.uint8)
    for r in hashes.mapInArrow(by_part, "part int, h binary").repartition(16, "part").mapInArrow(made, "part int, bits binary").toLocalIterator():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out


def passes(have: np.ndarray, h: np.ndarray) -> np.ndarray:
    part, out = _part(h), np.ones(len(h), bool)
    for b in _bits(h):
        out &= (have[part, b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0
    return out


def repeated_anchors(digests: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """Written (h binary, hot binary): the anchor hashes that two texts or two places of one text have, and those that many have."""

    def run(batches):
        h, own = [], []
        for batch in batches:
            for x, y in zip(batch.column(1), batch.column(2)):
                h.append(np.frombuffer(x.as_buffer(), "<u8"))
                own.append(np.frombuffer(y.as_buffer(), "<i8"))
        if h:
            h, own = np.concatenate(h), np.concatenate(own)
            o = np.lexsort((own, h))
            h, own = h[o], own[o]
            more = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))
            h, n = np.unique(h[more], return_counts=True)
            yield _record(["h", "hot"], [pa.binary(), pa.binary()], [(h[n > 1].tobytes(), h[n > hot].tobytes())])

    rows = digests.where("kind = 1").select(F.col("n_bytes").alias("bucket"), "h", "owner")
    return written(rows.repartition(parts, "bucket").mapInArrow(run, "h binary, hot binary"), "sa-anchors")


_POST = np.dtype([("h", "<u8"), ("e", "<u8"), ("node", "<i8"), ("low", "<u4"), ("k", "<u4"), ("at", "<u4"), ("sent", "<u4")])


def candidates(docs: DataFrame, have: np.ndarray, hot: np.ndarray, parts: int, window: int, gram: int) -> DataFrame:
    """The surroundings of the anchors that pass the filter, by bucket: posts (hash, surroundings' hash, node, start, starts, anchor) and
    the bytes of those that a task sends for the first time. Buckets from parts on hold ranges that need no comparison."""
    shared = docs.sparkSession.sparkContext.broadcast((have, hot if hot.any() else None))

    def run(batches):
        seen, times, (bits, hot_bits) = set(), {}, shared.value
        for _, buf, offs in slices(batches, "_text", SLICE):
            text, low, high, place, h, e = anchors(buf, offs, window, gram)
            if not len(text):
                continue
            nodes, _ = text_nodes(buf, offs)
            keep = _fresh(nodes, seen)[text] & passes(bits, h)
            text, low, high, place, h, e = text[keep], low[keep], high[keep], place[keep], h[keep], e[keep]
            rows = np.zeros(len(h), _POST)
            for f, v in (("h", h), ("e", e), ("node", nodes[text]), ("low", low - offs[text]), ("k", high - low + 1), ("at", place - low)):
                rows[f] = v
            view, blobs = buf.tobytes(), {}
            if hot_bits is not None and (many := passes(hot_bits, h)).any():
                extra = []
                for i in np.flatnonzero(many).tolist():
                    d = string_digests(view, int(low[i]), int(high[i]), window)
                    r = np.zeros(len(d), _POST)
                    r["h"], r["e"], r["node"], r["low"], r["k"], r["at"] = d[:, 0], d[:, 1], rows["node"][i], rows["low"][i] + np.arange(len(d)), 1, _DIGEST
                    extra.append(r)
                at = np.append(low[~many], np.zeros(sum(map(len, extra)), np.int64))
                rows = np.concatenate([rows[~many], *extra])
            else:
                at = low
            if len(times) > 1 << 20:
                times.clear()
            straight = np.zeros(len(rows), bool)
            for i, (x, own) in enumerate(zip(rows["e"].tolist(), (rows["at"] != _DIGEST).tolist())):
                c = times.get(x, 0)
                if c > 1:
                    straight[i] = True
                    continue
                times[x] = c + 1
                if c == 0 and own:
                    blobs[i] = view[at[i] : at[i] + int(rows["k"][i]) - 1 + window]
                    rows["sent"][i] = len(blobs[i])
            b = np.where(straight, parts + _bucket(rows["node"].view(np.uint64), parts), _bucket(rows["h"], parts))
            o = np.argsort(b, kind="stable")
            edges = np.searchsorted(b[o], np.arange(2 * parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(edges)).tolist():
                mine = o[edges[p] : edges[p + 1]]
                out.append((p, rows[mine].tobytes(), b"".join([blobs[i] for i in mine.tolist() if i in blobs])))
            if out:
                yield _record(["bucket", "posts", "bytes"], [pa.int32(), pa.binary(), pa.binary()], out)

    return docs.mapInArrow(run, "bucket int, posts binary, bytes binary")


def _resolved(posts: np.ndarray, texts: dict[int, bytes], window: int):
    """(node, first start, starts) of all ranges of repeated strings among the posts of a bucket."""
    posts = posts[np.lexsort((posts["low"], posts["node"], posts["e"], posts["h"]))]
    keep = np.ones(len(posts), bool)
    keep[1:] = (posts["e"][1:] != posts["e"][:-1]) | (posts["node"][1:] != posts["node"][:-1]) | (posts["low"][1:] != posts["low"][:-1])
    posts = posts[keep]
    new = np.ones(len(posts), bool)
    new[1:] = (posts["h"][1:] != posts["h"][:-1]) | (posts["e"][1:] != posts["e"][:-1])
    first = np.flatnonzero(new)  # one for each different surroundings
    times = np.diff(np.append(first, len(posts)))
    h = posts["h"][first]
    group = np.unique(h, return_inverse=True)[1]
    members = np.bincount(group)[group]
    whole = times > 1
    yield posts["node"][np.repeat(whole, times)], posts["low"][np.repeat(whole, times)], posts["k"][np.repeat(whole, times)]
    mixed = np.flatnonzero((members > 1) & (posts["at"][first] != _DIGEST))
    if len(mixed):
        for lot in _lots(mixed, group, posts["k"][first]):
            k = posts["k"][first[lot]].astype(np.int64)
            flag = repeated_starts([texts[int(x)] for x in posts["e"][first[lot]].tolist()], k, window)
            head = np.cumsum(k) - k
            own = np.repeat(np.arange(len(lot)), k)
            rise = flag.copy()
            rise[1:] &= ~(flag[:-1] & (own[1:] == own[:-1]))
            fall = flag.copy()
            fall[:-1] &= ~(flag[1:] & (own[1:] == own[:-1]))
            a, b = np.flatnonzero(rise), np.flatnonzero(fall) + 1
            i = own[a]
            ok = ~whole[lot[i]]  # those are in already; here each stands for one post
            p = first[lot[i[ok]]]
            yield posts["node"][p], posts["low"][p] + (a[ok] - head[i[ok]]).astype(np.uint32), (b[ok] - a[ok]).astype(np.uint32)


def _lots(some: np.ndarray, group: np.ndarray, k: np.ndarray, most: int = 1 << 17):
    """Runs of whole groups with about so many starts, to bound the arrays."""
    if not len(some):
        return
    sums = np.cumsum(k[some].astype(np.int64))
    edge = np.flatnonzero(np.append(group[some][1:] != group[some][:-1], True)) + 1
    at = 0
    while at < len(some):
        base = sums[at - 1] if at else 0
        e = edge[edge > at]
        fit = e[sums[e - 1] - base <= most]
        to = int(fit[-1]) if len(fit) else int(e[0])
        yield some[at:to]
        at = to


def ranges(cands: DataFrame, parts: int, window: int) -> DataFrame:
    """(node, ranges): packed (first start, starts) of the repeated strings of each text, from each bucket.

    A task has one bucket in memory at a time."""

    def resolved(bucket: int, posts: list, texts: dict):
        if bucket < parts:
            node, low, k = (np.concatenate(x) for x in zip(*_resolved(np.concatenate(posts), texts, window)))
        else:
            node, low, k = (np.concatenate([x[f] for x in posts]) for f in ("node", "low", "k"))
        o = np.lexsort((low, node))
        node, pair = node[o], np.stack([low[o], k[o]], 1).astype("<u4")
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        to = np.append(first[1:], len(node))
        for at in range(0, len(first), 10_000):
            f, t = first[at : at + 10_000], to[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(node[f]), pa.array([pair[a:b].tobytes() for a, b in zip(f, t)], pa.binary())], ["node", "ranges"])

    def run(batches):
        bucket, posts, texts = None, [], {}
        for batch in batches:
            for p, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != bucket and posts:
                    yield from resolved(bucket, posts, texts)
                    posts, texts = [], {}
                bucket, rows = p, np.frombuffer(x.as_py(), _POST)
                blob, sent = y.as_py(), np.flatnonzero(rows["sent"])
                ends = np.cumsum(rows["sent"][sent])
                for e, b, n in zip(rows["e"][sent].tolist(), ends.tolist(), rows["sent"][sent].tolist()):
                    texts[e] = blob[b - n : b]
                posts.append(rows)
        if posts:
            yield from resolved(bucket, posts, texts)
        posts, texts = [], {}
        trim()

    return written(cands.repartition(int_parts(cands.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "node long, ranges binary"), "sa-ranges")


def _merged(pairs: np.ndarray, window: int) -> np.ndarray:
    """Maximal removed runs (start, end) of ranges of starts."""
    a, b = pairs[:, 0].astype(np.int64), pairs[:, 0].astype(np.int64) + pairs[:, 1] - 1 + window
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return np.stack([a[first], b[np.append(first[1:], len(a)) - 1]], 1)


def removed_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, runs). texts: (doc_id, node, n_bytes, sha, copies) of each row; runs: (node, text, runs array<struct<a,b>>) of each
    different text with a repeat inside it or elsewhere, copies of it aside."""
    spark = docs.sparkSession
    parts = int_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_text"))
    digests = digest(rows, parts, window, gram)
    texts = rows.select("_text")
    repeated, buckets = repeated_anchors(digests, parts, hot), 8 * parts
    sent = candidates(texts, bloom(repeated.select("h")), bloom(repeated.select(F.col("hot").alias("h"))), buckets, window, gram)
    found = ranges(sent, buckets, window)

    def node_hashes(batches):
        for batch in batches:
            yield _record(["h"], [pa.binary()], [(np.unique(batch.column(0).to_numpy()).astype("<i8").tobytes(),)])

    shared = spark.sparkContext.broadcast(bloom(found.select("node").mapInArrow(node_hashes, "h binary")))

    def reached(batches):
        seen, bits = set(), shared.value
        for batch, buf, offs in slices(batches, "_text", SLICE):
            nodes, _ = text_nodes(buf, offs)
            i = np.flatnonzero(passes(bits, nodes.view(np.uint64)) & _fresh(nodes, seen))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(np.ones(len(i), np.int32)), batch.column(0).take(pa.array(i))], ["node", "kind", "blob"])

    def joined(batches):
        node, held = None, []
        for batch in batches:
            out = []
            for x, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if x != node:
                    node, held = x, []
                if kind == 0:
                    held.append(np.frombuffer(blob.as_buffer(), "<u4").reshape(-1, 2))
                elif held:  # of copies the first is enough
                    out.append((x, blob.as_py(), _merged(np.concatenate(held), window).astype("<i8").tobytes()))
                    held = []
            if out:
                yield _record(["node", "text", "runs"], [pa.int64(), pa.binary(), pa.binary()], out)
        out = None
        trim()

    moved = texts.mapInArrow(reached, "node long, kind int, blob binary").union(found.select("node", F.lit(0).alias("kind"), F.col("ranges").alias("blob")))
    runs = moved.repartition(parts, "node").sortWithinPartitions("node", "kind").mapInArrow(joined, "node long, text binary, runs binary")
    own = digests.where("kind = 0").select("doc_id", "node", "n_bytes", "sha")
    return own, runs


def dedup_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The query's columns for every row of docs."""
    own, runs = removed_runs(docs, window, gram, hot)

    def measured(batches):
        for batch in batches:
            out = []
            for node, text, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                r, h, at = np.frombuffer(r, "<i8").reshape(-1, 2), hashlib.sha256(), 0
                for a, b in r.tolist():
                    h.update(text[at:a])
                    at = b
                h.update(text[at:])
                out.append((node, hashlib.sha256(text).hexdigest(), int((r[:, 1] - r[:, 0]).sum()), len(r), h.hexdigest()))
            if out:
                yield _record(["node", "sha", "_removed", "_spans", "_sha"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()], out)

    measures = written(runs.mapInArrow(measured, "node long, sha string, _removed long, _spans long, _sha string"), "sa-measures")
    of_text = own.groupBy("node", "sha").agg(F.count("*").alias("_copies")).join(measures, ["node", "sha"], "left").where("_copies > 1 or _spans is not null")
    out = own.join(of_text, ["node", "sha"], "left")
    gone = (F.col("_copies") > 1) & (F.col("n_bytes") >= window)
    pick = lambda all_, some, none: F.when(gone, all_).otherwise(F.coalesce(some, none))
    return out.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(EMPTY_SHA), F.col("_sha"), F.col("sha")).alias("kept_sha256"),
    )


def _whole_characters(text: bytes, runs: np.ndarray) -> bytes:
    """text without the runs, each shrunk to whole characters."""
    out, at = [], 0
    for a, b in runs.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes (shrunk to whole characters) taken out of text, and n_chars to match where it is a column.

    Documents that lose every word go. Rows without a repeat are unchanged."""
    own, runs = removed_runs(docs, window, gram)

    def cleaned(batches):
        for batch in batches:
            rows = [(x, hashlib.sha256(t).hexdigest(), _whole_characters(t, np.frombuffer(r, "<i8").reshape(-1, 2)).decode("utf-8", "replace")) for x, t, r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            if rows:
                yield _record(["node", "sha", "_new"], [pa.int64(), pa.string(), pa.string()], rows)

    texts = written(runs.mapInArrow(cleaned, "node long, sha string, _new string"), "sa-texts")
    of_text = own.groupBy("node", "sha").agg(F.count("*").alias("_copies"), F.max("n_bytes").alias("_n")).join(texts, ["node", "sha"], "left")
    gone = (F.col("_copies") > 1) & (F.col("_n") >= window)
    changed = of_text.where(gone | F.col("_new").isNotNull()).select(F.col("sha").alias("_of"), F.when(gone, "").otherwise(F.col("_new")).alias("_new"))
    sha = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("_sha")
    out = docs.select(carried(docs), sha).join(changed, F.col("_sha") == F.col("_of"), "left")
    out = out.where(F.col("_new").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.coalesce("_new", "_doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_new").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns])
