"""Operator 13: grouping of spelling variants.

Words that are one edit apart (one code point inserted, deleted or replaced) are found by a positional index of their
q-grams, q = 3, with two marks before and behind each word. An edit destroys few grams: a replacement 3 of each word, an
insertion 2 of the shorter and 3 of the longer word. So near words share all others, at places that differ by at most
one, and lengths that differ by at most one.

* Index. The grams of a word are ordered by how many words hold them, the rarest first. By the above, the first gram that
  near words share is among the first 4 of the longer (or equal) one and the first 3 of the shorter one. Only those are
  sent: a word is indexed under (gram, place, length) of its first 4, and asks, besides there, under the two places and
  the length that an insertion can lead to. Equal keys meet in one task; the words of a key are few.
* Count filter. Within a key, the postings of all other grams form lists by (gram, place). A near word is missing from
  at most 3 (or 2) of a word's lists, so from some of any 4 (or 3) it is not: those that are shortest are merged, and the
  words met are kept if the grams shared with them reach the bound max(length) + 2 - 3.
* Verification compares what is left code point by code point.

Keys met by more than HOT words are split: each of their words is indexed in one part and asks in all. A part's index is
of bounded size; askers pass it in lots. What Spark broadcasts is the table of gram counts, whose size the alphabet bounds
(92 symbols, at most 778,688 grams).

Null texts have no words; a null doc_id counts as the text "null" in the deletion rule's hash; words of any length are
compared whole. Repeated rows count each time. Among equally frequent near words the least by code points is the form. An
empty table gives no rows; extra columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import trim, written

Q = 3
LEAST_LENGTH, LEAST_COUNT, DELETES = 5, 3, 97
#: Runs that are shorter can't give a word.
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of lower-cased runs, and two marks.
_SYMBOL = np.full(256, 0, np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[0xC0:0x100] = np.arange(26, 90)
BEFORE, BEHIND, SYMBOLS = 90, 91, 92
HOT = 1 << 14
LOT = 1 << 15  # rows of a key that are looked up together
EXPANDED = 1 << 21  # postings that are in memory together


def variant(doc: Column, run: Column) -> Column:
    """A run as it is counted: where 97 divides the hash of document and run, one code point is gone."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DELETES == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs after the deletion rule, of at least 5 code points and met at least 3 times."""
    runs = docs.select(F.col("doc_id").alias("d"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN % LEAST_LENGTH), F.lit(0))).alias("r"))
    some = runs.select(variant(F.col("d"), F.translate("r", UPPER, LOWER)).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return some.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Grams:
    """The positional grams of some words, end to end: gram, place; the grams of word i are those from at[i] to at[i + 1]."""

    def __init__(self, column: pa.Array) -> None:
        text = "".join(column.to_pylist())
        self.code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        self.length = np.array(pc.utf8_length(column), np.int64)
        ends = np.cumsum(self.length)
        self.start = ends - self.length
        row = np.repeat(np.arange(len(column)), self.length)
        wide = np.full(len(self.code) + 4 * len(column), BEFORE, np.int64)
        wide[np.arange(len(self.code)) + 4 * row + 2] = _SYMBOL[self.code]
        tail = ends + 4 * np.arange(len(column)) + 2
        wide[tail] = wide[tail + 1] = BEHIND
        count = self.length + Q - 1
        self.at = np.concatenate([[0], np.cumsum(count)])
        self.row = np.repeat(np.arange(len(column)), count)
        first = np.arange(len(self.row)) + 2 * self.row  # words have 2 symbols more than grams
        self.gram = (wide[first] * SYMBOLS + wide[first + 1]) * SYMBOLS + wide[first + 2]
        self.place = np.arange(len(self.row)) - self.at[self.row]


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from low[i] on, n[i] of them, for each i in turn."""
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)


def key(gram: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return K.mixed((gram * 1_000_003 + place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)).astype(np.int64)


def gram_counts(table: DataFrame) -> np.ndarray:
    """How many words' places hold each gram: a table whose size the alphabet bounds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**Q, np.int64)
        for b in batches:
            total += np.bincount(Grams(b.column(0)).gram, minlength=SYMBOLS**Q)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = table.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**Q, np.int64)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


def postings(table: DataFrame) -> DataFrame:
    """(key, held, word, n): words (word, n) under the keys where they are indexed (held), and those where they only ask."""
    spark = table.sparkSession
    counts = gram_counts(table)
    order = np.empty(len(counts), np.int32)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    shared = spark.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = Grams(b.column(0))
            by = np.lexsort((g.place, shared.value[g.gram], g.row))
            nth = np.arange(len(by)) - g.at[g.row[by]]
            four, three = by[nth < 4], by[nth < 3]
            size = g.length[g.row]
            rows = np.concatenate([g.row[four], g.row[three], g.row[three]])
            keys = np.concatenate([key(g.gram[x], g.place[x] + p, size[x] + n) for x, p, n in ((four, 0, 0), (three, 0, 1), (three, 1, 1))])
            held = np.arange(len(rows)) < len(four)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(held), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], ["key", "held", "word", "n"])

    return table.select("word", "n").mapInArrow(run, "key long, held boolean, word string, n long")


def split(rows: DataFrame, hot: int) -> DataFrame:
    """rows with part: those of a key with more than hot words indexed are dealt to parts, and ask in all parts."""
    sizes = rows.where("held").groupBy("key").agg(F.count("*").alias("_c")).where(F.col("_c") > hot)
    parts = sizes.select(F.col("key").alias("_k"), F.ceil(F.col("_c") / hot).cast("int").alias("_parts"))
    both = rows.join(parts, F.col("key") == F.col("_k"), "left")
    own = F.when(F.col("held") & F.col("_parts").isNotNull(), F.pmod(F.xxhash64("word"), "_parts").cast("int"))
    each = F.explode(F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return both.withColumn("_own", own).select("key", "held", "word", "n", "_own", each.alias("part")).select("key", "part", (F.col("held") & (F.col("_own").isNull() | (F.col("_own") == F.col("part")))).alias("held"), "word", "n")


def _edited(g: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of words a, b (b as long as a, or one longer) are exactly one edit apart."""
    n = g.length[a]
    p = _ranges(g.start[a], n)
    q = _ranges(g.start[b], n)
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = p - np.repeat(g.start[a], n)
    same = g.code[p] == g.code[q]
    longer = g.length[b] > n
    behind = g.code[p] == g.code[np.minimum(q + 1, len(g.code) - 1)]
    first = np.minimum.reduceat(np.where(same, np.int64(1) << 40, place), at)  # the first place that differs
    last = np.maximum.reduceat(np.where(behind, -1, place), at)  # the last one that differs from the next place
    return np.where(longer, last < first, np.add.reduceat(~same, at) == 1)


def near_in(keys: np.ndarray, held: np.ndarray, asks: np.ndarray, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, row) of near words with equal keys: of rows that ask with those that are held, as long as they or one longer."""
    g = Grams(words)
    inside = np.flatnonzero(held[g.row])
    tag = lambda x, place: K.mixed((keys[g.row[x]].astype(np.uint64) ^ (g.gram[x] * 4099 + place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, group = np.unique(keys, return_inverse=True)
    size = np.zeros(int(group.max()) + 1, np.int64)  # of the held words of a key
    size[group[held]] = g.length[held]
    lists = tag(inside, g.place[inside])
    by = np.argsort(lists, kind="stable")
    lists, member = lists[by], g.row[inside][by]
    more = size[group] - g.length  # 0 or 1, or no held word of the key in this lot
    ask = np.flatnonzero(asks[g.row] & (more[g.row] >= 0) & (more[g.row] <= 1))
    if not len(ask) or not len(lists):
        return
    low, n = [], []
    for shift in (0, 1):  # a list by the same place, and by the next one, of longer words
        h = tag(ask, g.place[ask] + shift)
        a = np.searchsorted(lists, h, "left")
        low.append(a)
        n.append(np.where((shift == 0) | (more[g.row[ask]] == 1), np.searchsorted(lists, h, "right") - a, 0))
    both = n[0] + n[1]
    row = g.row[ask]
    by = np.lexsort((both, row))  # a word's shortest lists first; all it has, the key's own gram too, count here
    first = np.searchsorted(row[by], row[by], "left")
    by = by[np.arange(len(by)) - first < np.where(more[row[by]] == 1, 3, 4)]
    cut = np.cumsum(both[by]) // EXPANDED
    edges = np.flatnonzero(np.diff(row[by], prepend=-1))  # lots end between words
    lot = np.maximum.accumulate(np.where(np.isin(np.arange(len(by)), edges), cut, 0))
    for part in np.split(by, np.flatnonzero(np.diff(lot)) + 1):
        a = np.concatenate([np.repeat(row[part], n[s][part]) for s in (0, 1)])
        b = np.concatenate([member[_ranges(low[s][part], n[s][part])] for s in (0, 1)])
        pair = K.distinct((a * len(keys) + b).astype(np.int64))
        a, b = pair // len(keys), pair % len(keys)
        # Of words of one length that are both held and both ask, the earlier row asks.
        some = (a != b) & ((a < b) | (more[a] == 1) | ~held[a] | ~asks[b])
        a, b = a[some], b[some]
        for i in range(0, len(a), EXPANDED // 8):
            x, y = a[i : i + EXPANDED // 8], b[i : i + EXPANDED // 8]
            ok = _shared(g, x, y) >= g.length[y] + 2 - Q
            x, y = x[ok], y[ok]
            if len(x):
                ok = _edited(g, x, y)
                yield x[ok], y[ok]


def _shared(g: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The grams of a that b has at the same place, or at the next one if b is longer."""
    n = g.at[a + 1] - g.at[a]
    p, q = _ranges(g.at[a], n), _ranges(g.at[b], n)
    longer = np.repeat(g.length[b] > g.length[a], n)
    same = (g.gram[p] == g.gram[q]) | (longer & (g.gram[p] == g.gram[np.minimum(q + 1, len(g.gram) - 1)]))
    return np.add.reduceat(same, np.concatenate([[0], np.cumsum(n)])[:-1]) if len(a) else np.zeros(0, np.int64)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n of a, n of b) of rows (key, part, held, word, n) sorted by key and part, held ones first."""
    kept, asked = None, 0  # rows of keys that may go on; so many of the first of them have asked
    for b in batches:
        for at in range(0, b.num_rows, LOT):
            t = pa.Table.from_batches([b.slice(at, LOT)])
            kept = t if kept is None else pa.concat_tables([kept, t])
            if kept.num_rows - asked < LOT:
                continue
            yield from _pairs(kept, asked)
            # The last key may go on: its held rows stay.
            k, part = kept["key"].to_numpy(), kept["part"].to_numpy()
            kept = kept.filter(pa.array((k == k[-1]) & (part == part[-1]) & kept["held"].to_numpy())).combine_chunks()
            asked = kept.num_rows
    if kept is not None and kept.num_rows > asked:
        yield from _pairs(kept, asked)
    trim()


def _pairs(rows: pa.Table, asked: int) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    keys = rows["key"].to_numpy() + rows["part"].to_numpy() * np.int64(0x9E3779B97F4A7)
    word, n, held = rows["word"].combine_chunks(), rows["n"].combine_chunks(), rows["held"].to_numpy()
    for a, b in near_in(keys, held, np.arange(len(keys)) >= asked, word):
        a, b = pa.array(a), pa.array(b)
        yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(a), n.take(b)], ["a", "b", "n_a", "n_b"])


def near_pairs(table: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b, n_a, n_b), a before b, for all pairs of words (word, n) that are one edit apart."""
    rows = split(written(postings(table), "spelling-postings"), hot).repartition("key", "part").sortWithinPartitions("key", "part", F.desc("held"))
    found = rows.select("key", "part", "held", "word", "n").mapInArrow(_near, "a string, b string, n_a long, n_b long")
    first = F.col("a") < F.col("b")
    return found.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n_a", "n_b"), ("n_b", "n_a"))]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) that have one: the end of the path of forms, by pointers that double.

    A form is met at least twice as often, so paths are shorter than the logarithm of the greatest count."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs."""
    table = written(words(docs), "spelling-words")
    pairs = written(near_pairs(table, hot), "spelling-pairs")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("most"))
    much = -F.col("most.less") >= 2 * F.col("n")
    formed = written(
        table.join(best, "word", "left").select(
            "word", F.when(much, F.col("most.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, -F.col("most.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
