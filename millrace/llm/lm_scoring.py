"""Operator 7: language-model scoring with a log-frequency Bloom filter.

The filter: a count c is quantised to a level, exact up to EXACT and then STEPS levels a doubling; an n-gram is put in with
each level from 1 to its own, words and bigrams alike, those met once too. Each bucket of n-gram hashes owns a segment of
the bit array, so the filter grows with the input and nothing gives way; it is in no place as a whole. The probes of an
item follow the vocabulary: 2 ** -probes is under 1 / (100 V), so that over a whole vocabulary the words that a context
only seems to have had weigh less than a hundredth of one count. A segment follows from its bucket's items alone, and the
number of buckets from the bytes of the texts, so other partitions of the input give the same scores.

One exchange: a chunk of texts sends each bucket its different n-grams, sorted by hash, and how often its training texts
hold them. A bucket's task sums the counts, builds the segment in memory, probes it for each chunk's n-grams and answers
with their levels, in the same order, and for words also with their exact counts. Buckets are ranges of the hash, so the
answers in the order of buckets line up with the chunk's sorted n-grams. A bucket holds what some 4 MB of texts ask,
whatever the input; a frequent word is one number a chunk.

The model: P(w | v) = (c(v w) + PRIOR * P(w)) / (c(v) + PRIOR) with P(w) = (c(w) + 1) / (N + V + 1). In the numerators counts
are the middles of their levels, read by membership probes. c(v), the total of what follows v, is the word's exact count,
and N the sum of all middles. So P(w) sums to 1 exactly over the words met and one unknown word, and P(w | v) up to what
rounding to levels leaves of c(v). The first word of a text is conditioned on the end before it.

Null texts are empty and hold the end only; a null doc_id is not held out; repeated rows score alike; texts longer than a
chunk are a chunk of their own; an empty table gives no rows; extra columns are ignored. With nothing to learn from, N = V
= 0 and each token has probability 1."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import int_parts, slices, trim, written

#: Levels: each count up to EXACT, then so many a doubling. Counts beyond the last level stay at it.
EXACT, STEPS = 8, 4
LEVELS = EXACT + STEPS * 48
#: Bits of the filter for each of an item's probes: with 1 / ln 2 half of the bits are set.
BITS = 1 / math.log(2)
LEAST_PROBES = 16
PRIOR = 100.0
END = np.uint64(0x656E646F66746578)
SLICE = 1 << 22  # bytes of texts in a chunk
BUCKET = 1 << 22  # bytes of texts for each bucket
LEAST_BUCKET_BITS = 8


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the tokens of each text, its end last."""
    low = K.LOWER[buf]
    starts, ends, owner = K.words(low, offs)
    h = K.span_hashes(K.prefix(low), starts, ends)
    n = len(offs) - 1
    order = np.concatenate([owner * 2, np.arange(n) * 2 + 1]).argsort(kind="stable")
    return np.concatenate([h, np.full(n, END)])[order], np.concatenate([owner, np.arange(n)])[order]


def _bigrams(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each token the hash of it and the one before it in its text (END at the head)."""
    before = np.empty_like(h)
    if len(h):
        before[0] = END
        before[1:] = np.where(owner[1:] == owner[:-1], h[:-1], END)
    return K.mixed(before * np.uint64(0x9FB21C651E98DF25) + h * np.uint64(3))


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return h, c
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


def bucket_bits(rows: DataFrame) -> int:
    """Buckets, as a power of two, follow the bytes of the texts (column _text)."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(LEAST_BUCKET_BITS, (size // BUCKET).bit_length())


def _by_bucket(bits: int, h: np.ndarray, *more: np.ndarray):
    """(bucket, h, *more) of each bucket of sorted h."""
    edges = np.searchsorted((h >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, *(x[edges[b] : edges[b + 1]] for x in (h, *more))


def level_of(c: np.ndarray) -> np.ndarray:
    """The level of each count, 0 of none."""
    c = c.astype(np.float64)
    up = EXACT + np.floor(STEPS * np.log2(np.maximum(c, EXACT) / EXACT) + 1e-9)
    return np.minimum(np.where(c <= EXACT, c, up).astype(np.int64), LEVELS)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: itself up to EXACT, then the mean of the counts of its range."""
    low = np.ceil(EXACT * 2.0 ** ((level - EXACT) / STEPS) - 1e-6)
    high = np.ceil(EXACT * 2.0 ** ((level + 1 - EXACT) / STEPS) - 1e-6) - 1
    return np.where(level < EXACT, level, (low + np.maximum(high, low)) / 2)


def probes_for(vocabulary: int) -> int:
    """So many that a miss passes for a hit less often than once in 100 vocabularies."""
    return max(LEAST_PROBES, math.ceil(math.log2(100 * max(vocabulary, 1))) + 1)


class Filter:
    """A segment of the log-frequency Bloom filter: an array of bits, and the probes of an item."""

    def __init__(self, bits: np.ndarray, probes: int) -> None:
        self.bits, self.probes = bits, probes

    def _start(self, h: np.ndarray, n: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An item's first place before it is cut to the size, the step to the second, and what each step grows by."""
        at = K.mixed(h + np.uint64((n * 1_000_003 + level * 8191) * 0x9E3779B97F4A7C15 % (1 << 64)))
        step = K.mixed(at)
        return at, step, K.mixed(step)

    def put(self, h: np.ndarray, n: int, level: int) -> None:
        at, step, turn = self._start(h, n, level)
        for _ in range(self.probes):
            self.bits[(at % np.uint64(len(self.bits))).astype(np.intp)] = True
            at, step = at + step, step + turn

    def level(self, h: np.ndarray, n: int) -> np.ndarray:
        """The level of each n-gram: the last in a row of hits, 0 if the first misses."""
        out = np.zeros(len(h), np.int64)
        left, level = np.arange(len(h)), 1
        while len(left) and len(self.bits) and level <= LEVELS:
            at, step, turn = self._start(h[left], n, level)
            for _ in range(self.probes):
                hit = self.bits[(at % np.uint64(len(self.bits))).astype(np.intp)]
                if not hit.all():
                    left, at, step, turn = left[hit], at[hit], step[hit], turn[hit]
                at, step = at + step, step + turn
            out[left] = level
            level += 1
        return out


def segment(grams: dict[int, tuple[np.ndarray, np.ndarray]], probes: int) -> Filter:
    """A segment with all {n: (hashes, counts)} at every level they reach, sized by their number."""
    levels = {n: level_of(c) for n, (_, c) in grams.items()}
    made = Filter(np.zeros(math.ceil(BITS * probes * int(sum(q.sum() for q in levels.values()))), bool), probes)
    for n, (h, _) in grams.items():
        q = levels[n]
        for level in range(1, int(q.max(initial=0)) + 1):
            h, q = h[q >= level], q[q >= level]
            made.put(h, n, level)
    return made


def text_scores(back: np.ndarray, inverse: np.ndarray, owner: np.ndarray, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, end: float, n: int, totals: dict, prior: float = PRIOR) -> np.ndarray:
    """The model's log10 probability of each of n texts, from the levels of their different words and pairs and the exact counts of
    the words and of the end."""
    one, both, exact = middle(words)[inverse], middle(pairs)[back], counts.astype(np.float64)[inverse]
    before = np.concatenate([[end], np.where(owner[1:] == owner[:-1], exact[:-1], end)]) if len(one) else one
    p = (one + 1) / (totals["M"] + totals["V"] + 1)
    # A pair is met no more often than the word it starts with.
    return np.bincount(owner, weights=np.log10((np.minimum(both, before) + prior * p) / (before + prior)), minlength=n)


_NAMES = ["chunk", "n", "bucket", "ids", "held", "h", "c"]
_ROWS = "chunk long, n int, bucket int, ids array<long>, held array<boolean>, h binary, c binary"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]


def _packed(buf: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(buf)), codec="zstd", asbytes=True) if len(buf) else b""


def _unpacked(blob: pa.Scalar, offs: np.ndarray) -> np.ndarray:
    n = int(offs[-1])
    return np.frombuffer(pa.decompress(blob.as_buffer(), n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)


def _batch(rows: list) -> pa.RecordBatch:
    """Rows (chunk, n, bucket, ids, held, h, c)."""
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)


def _narrow(c: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs, the first byte saying how many."""
    size = next(k for k in (1, 2, 4, 8) if int(c.max(initial=0)) < 1 << (8 * k))
    return bytes([size]) + c.astype(f"<u{size}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.uint64) if blob else np.zeros(0, np.uint64)


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, _text) as chunks of texts, written: a row each with n = 0, the texts' ids and held flags."""

    def run(batches):
        part, at = TaskContext.get().partitionId() << 33, 0
        for batch, buf, offs in slices(batches, "_text", SLICE):
            yield _batch([(part + at, 0, -1, batch.column(0).to_pylist(), batch.column(1).to_pylist(), _packed(buf), offs.astype("<i8").tobytes())])
            at += 1

    return written(rows.mapInArrow(run, _ROWS), "lm-chunks")


def asked(texts: DataFrame, bits: int) -> DataFrame:
    """A row for each chunk, n and bucket: the chunk's different n-grams there, and their counts in its training texts."""

    def run(batches):
        for batch in batches:
            for k, held, x, y in zip(*(batch.column(i) for i in (0, 4, 5, 6))):
                offs = np.frombuffer(y.as_buffer(), "<i8")
                h, owner = _tokens(_unpacked(x, offs), offs)
                learnt = ~np.array(held.as_py(), bool)[owner]
                for n, g in ((1, h), (2, _bigrams(h, owner))):
                    u, c = _summed(g, learnt.astype(np.uint64))
                    for at in _lots(list(_by_bucket(bits, u, c))):
                        yield _batch([(k.as_py(), n, b, None, None, x.tobytes(), _narrow(y)) for b, x, y in at])
        trim()

    return texts.mapInArrow(run, _ROWS)


def _lots(rows: list, size: int = 4096):
    return (rows[i : i + size] for i in range(0, len(rows), size))


def answered(questions: DataFrame, bits: int) -> DataFrame:
    """For each question the levels (h), and for words the exact counts (c), in its order; and for each bucket a row of chunk -1
    with its sums: words met, different words, middles of the words' levels."""

    def bucket_rows(bucket: int, rows: list):
        grams = {}
        for n in (1, 2):
            some = [(np.frombuffer(h, "<u8"), _wide(c)) for _, m, h, c in rows if m == n]
            if some:
                h, c = _summed(*(np.concatenate(x) for x in zip(*some)))
                grams[n] = h[c > 0], c[c > 0]
        words, counts = grams.get(1, (np.zeros(0, np.uint64),) * 2)
        model = segment(grams, probes_for(len(words) << bits))
        sums = np.array([counts.sum(), len(words), middle(level_of(counts)).sum()], "<f8")
        yield _batch([(-1, 0, bucket, None, None, sums.tobytes(), None)])
        for lot in _lots(rows, 1024):
            out = []
            for n in (1, 2):
                some = [(k, np.frombuffer(h, "<u8")) for k, m, h, _ in lot if m == n]
                if not some:
                    continue
                every, ends = np.concatenate([x for _, x in some]), np.cumsum([len(x) for _, x in some]).tolist()
                different, back = np.unique(every, return_inverse=True)
                levels = model.level(different, n).astype("u1")[back]
                if n == 1:
                    i = np.minimum(np.searchsorted(words, different), max(len(words) - 1, 0))
                    exact = (np.where(words[i] == different, counts[i], 0) if len(words) else np.zeros(len(different), np.uint64))[back]
                for (k, x), e in zip(some, ends):
                    out.append((k, n, bucket, None, None, levels[e - len(x) : e].tobytes(), _narrow(exact[e - len(x) : e]) if n == 1 else None))
            yield _batch(out)

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            for k, n, b, h, c in zip(*(batch.column(i) for i in (0, 1, 2, 5, 6))):
                if b.as_py() != bucket:
                    if rows:
                        yield from bucket_rows(bucket, rows)
                    bucket, rows = b.as_py(), []
                rows.append((k.as_py(), n.as_py(), h.as_py(), c.as_py()))
        if rows:
            yield from bucket_rows(bucket, rows)
        rows = None
        trim()

    parts = min(1 << bits, 4 * int_parts(questions.sparkSession))
    return written(questions.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROWS), "lm-answers")


def summed_up(answers: DataFrame) -> dict:
    """The totals {'N', 'V', 'M'}: words met, different ones, and the sum of the middles of their levels."""

    def sums(batches):
        for batch in batches:
            x = np.array([np.frombuffer(h.as_buffer(), "<f8") for h in batch.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in x.sum(0)], ["N", "V", "M"])

    got = answers.where("chunk = -1").select("h").mapInArrow(sums, "N double, V double, M double").agg(*[F.sum(x).alias(x) for x in "NVM"]).first()
    return {"N": int(got["N"] or 0), "V": int(got["V"] or 0), "M": got["M"] or 0.0}


def lm_scores(docs: DataFrame, held_out: int = 2, modulus: int = 7) -> DataFrame:
    """The query's columns for every row of docs."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("_text"))
    bits = bucket_bits(rows)
    texts = chunks(rows)  # written, so the chunks that ask and those that are answered are the same
    answers = answered(asked(texts, bits), bits)
    totals = summed_up(answers)
    each = math.log10(totals["N"] + totals["V"] + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(batches):  # a chunk's texts, then the answers on its words, then on its pairs, by bucket
        def done():
            ids, held, buf, offs = texts
            words, pairs = (np.frombuffer(b"".join(got[n]), "u1").astype(np.int64) for n in (1, 2))
            exact = np.concatenate([_wide(c) for c in got[3]])
            m = len(offs) - 1
            h, owner = _tokens(buf, offs)
            u, inverse = np.unique(h, return_inverse=True)
            back = np.unique(_bigrams(h, owner), return_inverse=True)[1]
            score = text_scores(back, inverse, owner, words, exact, pairs, float(exact[np.searchsorted(u, END)]), m, totals)
            c, tokens = exact[inverse].astype(np.float64), np.bincount(owner, minlength=m)
            base = np.bincount(owner, weights=np.log10(c + 1), minlength=m) - tokens * each
            known = np.bincount(owner, weights=c > 0, minlength=m).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens), pa.array(known), pa.array(np.full(m, totals["N"], np.int64)), pa.array(base), pa.array(score)], names)

        texts, got = None, {}
        for batch in batches:
            for _, n, _, ids, held, x, y in zip(*batch.columns):
                n = n.as_py()
                if n == 0:
                    if texts:
                        yield done()
                    offs = np.frombuffer(y.as_py(), "<i8")
                    texts, got = (ids.as_py(), held.as_py(), _unpacked(x, offs), offs), {1: [], 2: [], 3: []}
                else:
                    got[n].append(x.as_py())
                    if n == 1:
                        got[3].append(y.as_py())
        if texts:
            yield done()
        trim()

    both = texts.union(answers.where("chunk >= 0")).repartition(4 * int_parts(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "n", "bucket")
    return both.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
