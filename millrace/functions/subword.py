"""Trained subword vocabularies: byte-pair encoding, word pieces, greedy longest match.

Training is distributed, in one way at all sizes. All different words are spelled out once as arrays of symbol numbers, in
shards of a bounded number of symbols, and written. A job makes a batch of merges in every shard, an array pass for the
whole batch, and counts again only the words that hold one of its pairs: what comes back are the changes of pair counts,
summed in Spark. The driver keeps the counts of pairs of neighbouring symbols, no words: a table that the alphabet and the
merges bound, whatever the corpus. It chooses as many merges for the next batch as can't change each other's order.
Encoding runs in Arrow functions over pieces of a batch, with a bounded cache of words; longest matches are found by descent in a trie."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.pieces import by_pieces
from millrace.functions.text import adjacent_pairs, by_space, counted
from millrace.sources.shared import dropped, written

END = "</w>"
UNKNOWN = "[UNK]"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return counted(df, by_space, "word", text)


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, n): neighbouring symbols of (word, n), each weighted by its word's count."""
    symbols = F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit(END)))
    return words.select("n", F.explode(adjacent_pairs(symbols)).alias("p")).groupBy("p.l", "p.r").agg(F.sum("n").alias("n"))


def training_words(df: DataFrame, text: str = "text", most: int = 50_000) -> dict[str, int]:
    """The most frequent words, ties by word: a bounded table for the driver."""
    return {r["word"]: r["n"] for r in word_counts(df, text).orderBy(F.col("n").desc(), "word").limit(most).collect()}


def _joined(symbols: tuple[str, ...], pair: tuple[str, str]) -> tuple[str, ...]:
    """symbols with each occurrence of the pair made one symbol, from the left."""
    out, i = [], 0
    while i < len(symbols):
        if symbols[i : i + 2] == pair:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return tuple(out)


SHARD = 1 << 20  # symbols of a shard
CUT = 16  # batches after which the shards are written anew
ALONE = (1 << 31) - 1  # in the place of a pair's right symbol: the left one's own count
Batch = list[tuple[int, int, int]]  # (left, right, what they make), no symbol twice


def _keys(at: np.ndarray, weight: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbours in one number each, and the symbols alone, with their weights."""
    both = (at[:-1] >= 0) & (at[1:] >= 0)
    key, n = at[:-1][both] << 32 | at[1:][both], weight[:-1][both]
    if singles:
        real = at >= 0
        key, n = np.concatenate([key, at[real] << 32 | ALONE]), np.concatenate([n, weight[real]])
    return key, n


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(key, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, n)
    return key[total != 0], total[total != 0]


def _merged(at: np.ndarray, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(at with each of the batch's pairs made one symbol, from the left; the places of the pairs before that). Words end with -1."""
    most = max(int(at.max(initial=0)), *(x for m in batch for x in m)) + 2
    right, made = np.full(most, -2, np.int64), np.zeros(most, np.int64)
    for l, r, m in batch:
        right[l], made[l] = r, m
    hits = np.flatnonzero(right[at[:-1]] == at[1:])  # -1 looks at the last entry, which nothing equals
    run = at[hits] == at[hits + 1]
    if run.any():  # of a run of equal symbols every other place
        place = np.arange(len(hits))
        opens = np.diff(hits, prepend=-2) > 1
        hits = hits[~run | ((place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0)]
    out = at.copy()
    out[hits] = made[at[hits]]
    return np.delete(out, hits + 1), hits


class _Training:
    """The shards of a training as last written, the batches since, and the counts of pairs (and of symbols, for singles)."""

    def __init__(self, words: DataFrame, singles: bool, *end: str) -> None:
        words = written(words.select("word", "n"), "words")
        self.singles, self.pending = singles, []
        letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
        self.names = sorted({r["c"] for r in letters} | set(end))
        self.number = {c: i for i, c in enumerate(self.names)}
        number, tail = self.number, [self.number[e] for e in end]

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, weight, size = [], [], 0

            def shard() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([np.array([x for w in at for x in w], "<i4").tobytes()]), pa.array([np.array(weight, "<i8").tobytes()])], ["at", "weight"])

            for b in batches:
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at.append([*map(number.__getitem__, word), *tail, -1])
                    weight.append(1 if singles else n)
                    size += len(at[-1])
                    if size >= SHARD:
                        yield shard()
                        at, weight, size = [], [], 0
            if at:
                yield shard()

        self.table = written(words.repartition("word").mapInArrow(spell, "at binary, weight binary"), "shards")
        dropped(words)
        self.keys, self.counts = self._counted(None)

    def _shards(self, work, schema: str) -> DataFrame:
        """work(symbols, each word's weight) -> record batch, over the shards as they are after the batches since the last writing."""
        pending = list(self.pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, w in zip(b.column(0), b.column(1)):
                    at = np.frombuffer(x.as_buffer(), "<i4").astype(np.int64)
                    for batch in pending:
                        at = _merged(at, batch)[0]
                    yield work(at, np.frombuffer(w.as_buffer(), "<i8"))

        return self.table.mapInArrow(run, schema)

    def _counted(self, batch: Batch | None) -> tuple[np.ndarray, np.ndarray]:
        """What a batch changes in the counts, or the counts themselves."""
        singles = self.singles

        def count(at: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
            word = np.cumsum(at == -1) - (at == -1)  # the word of each place
            if batch is None:
                key, n = _keys(at, weight[word], singles)
            else:
                new, hits = _merged(at, batch)
                touched = np.zeros(len(weight), bool)
                touched[word[hits]] = True
                now = np.cumsum(new == -1) - (new == -1)
                was, be = touched[word], touched[now]
                k0, n0 = _keys(at[was], weight[word[was]], singles)
                k1, n1 = _keys(new[be], weight[now[be]], singles)
                key, n = np.concatenate([k0, k1]), np.concatenate([-n0, n1])
            key, n = _summed(key, n)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        got = self._shards(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        return got["key"].to_numpy(), got["n"].to_numpy()

    def merge(self, pairs: list[tuple[str, str]]) -> None:
        """Make each of the pairs, which share no symbol, one symbol."""
        batch = []
        for a, b in pairs:
            if a + b not in self.number:
                self.number[a + b] = len(self.names)
                self.names.append(a + b)
            batch.append((self.number[a], self.number[b], self.number[a + b]))
        key, n = self._counted(batch)
        self.keys, self.counts = _summed(np.concatenate([self.keys, key]), np.concatenate([self.counts, n]))
        self.pending.append(batch)
        if len(self.pending) >= CUT:
            blob = lambda at, weight: pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([weight.tobytes()])], ["at", "weight"])
            old, self.table = self.table, written(self._shards(blob, "at binary, weight binary"), "shards")
            self.pending = []
            dropped(old)

    def _pair(self, key: int) -> tuple[str, str]:
        return self.names[key >> 32], self.names[key & ALONE]

    def frequent(self, most: int) -> dict[tuple[str, str], int]:
        """The most frequent pairs, at least so many if there are, all of an equal count or none."""
        if not len(self.counts):
            return {}
        least = np.partition(self.counts, -most)[-most] if len(self.counts) > most else self.counts.min()
        return {self._pair(k): n for k, n in zip(self.keys[self.counts >= least].tolist(), self.counts[self.counts >= least].tolist())}

    def likeliest(self) -> tuple[str, str] | None:
        """The pair of the highest count over the product of its symbols' counts, ties by symbols."""
        alone = self.keys & ALONE == ALONE
        single = np.zeros(len(self.names), np.float64)
        single[self.keys[alone] >> 32] = self.counts[alone]
        key, n = self.keys[~alone], self.counts[~alone]
        if not len(key):
            return None
        score = n / (single[key >> 32] * single[key & ALONE])
        return min(self._pair(k) for k in key[score == score.max()].tolist())


def next_merges(pairs: dict[tuple[str, str], int], most: int) -> list[tuple[str, str]]:
    """The most frequent pairs in the order of single merges, as far as these can't change it: they share no symbol with
    one before, and occur more often than each pair that does."""
    order = sorted((p for p, n in pairs.items() if n > 0), key=lambda p: (-pairs[p], p))
    out, used = order[:1], set(order[0]) if order else set()
    for p in order[1:]:
        touched = any(x in used for x in p)
        if len(out) == most or touched:
            break
        # A tie with a pair that shares a symbol could turn on the new symbols.
        if any(pairs[q] == pairs[p] and any(x in used for x in q) for q in order[len(out) :] if pairs[q] >= pairs[p]):
            break
        out.append(p)
        used |= set(p)
    return out


def learnt_bpe(words: DataFrame, merges: int) -> list[tuple[str, str]]:
    """Up to that many merges over all different (word, n): the most frequent pair first, ties by the pair's symbols."""
    state, out = _Training(words, False, END), []
    while len(out) < merges:
        best = next_merges(state.frequent(512), merges - len(out))
        for k, (a, b) in enumerate(best):
            if a + b in state.number or a + b in {x + y for x, y in best[:k]}:
                best = best[: k + 1]  # its symbol has counts already: what follows has to see them
                break
        if not best:
            break
        out += best
        state.merge(best)
    dropped(state.table)
    return out


def learnt_wordpiece(words: DataFrame, size: int) -> set[str]:
    """All characters of the different words of (word, n), then joins by count of the pair over the product of its parts' counts,
    ties by symbols, up to size. A join changes the score of all that its symbols are in, so each is a batch of its own."""
    state = _Training(words, True)
    vocab = set(state.names)
    while len(vocab) < size:
        best = state.likeliest()
        if not best:
            break
        vocab.add(best[0] + best[1])
        state.merge([best])
    dropped(state.table)
    return vocab


def bpe_symbols(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    s = (*word, END)
    while len(s) > 1:
        best = min(zip(s, s[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        s = _joined(s, best)
    return list(s)


class Trie:
    """A set of texts by their characters, for the longest that starts at a place: one step down for each character."""

    def __init__(self, texts: Iterable[str]) -> None:
        self.root: dict = {}
        for t in texts:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[None] = True

    def longest(self, text: str, at: int) -> int:
        """Where the longest of the set that starts at a place ends, the place itself if there is none."""
        node, end = self.root, at
        for to in range(at, len(text)):
            node = node.get(text[to])
            if node is None:
                break
            if None in node:
                end = to + 1
        return end


def wordpiece_tries(vocab: set[str]) -> tuple[Trie, Trie]:
    """For the first piece of a word, and for later ones, which may stand with their ## or bare."""
    return Trie(vocab), Trie({v.removeprefix("##") if len(v) > 2 else v for v in vocab} | vocab)


def wordpiece(word: str, tries: tuple[Trie, Trie]) -> list[str]:
    """Greedy longest pieces, later ones with ##; the whole word is unknown if a piece is missing."""
    out, at = [], 0
    while at < len(word):
        to = tries[at > 0].longest(word, at)
        if to == at:
            return [UNKNOWN]
        out.append("##" * (at > 0) + word[at:to])
        at = to
    return out


def wordpiece_text(tokens: Column) -> Column:
    """Pieces joined to words again: ## continues the word before."""
    return F.ltrim(F.aggregate(tokens, F.lit(""), lambda a, t: F.when(t.startswith("##"), F.concat(a, F.substring(t, 3, 1_000_000))).otherwise(F.concat(a, F.lit(" "), t))))


def longest_match(word: str, trie: Trie) -> list[str]:
    """Greedy longest vocabulary entries; a character without one stands for itself."""
    out, at = [], 0
    while at < len(word):
        to = max(trie.longest(word, at), at + 1)
        out.append(word[at:to])
        at = to
    return out


KEPT = 1 << 15  # words whose tokens a task keeps


def encoder(encode_word):
    """An Arrow function text -> tokens, over pieces of a batch; the words last met are encoded once a task."""

    def work():
        cache: dict[str, list[str]] = {}

        def tokens(t: str | None) -> list[str] | None:
            if t is None:
                return None
            out = []
            for w in t.split():
                got = cache.get(w)
                if got is None:
                    if len(cache) >= KEPT:
                        cache.clear()
                    got = cache[w] = encode_word(w)
                out += got
            return out

        return tokens

    return by_pieces(work, "array<string>", pa.list_(pa.string()))


def bpe_encoder(merges: list[tuple[str, str]]):
    ranks = {p: i for i, p in enumerate(merges)}
    return encoder(lambda w: bpe_symbols(w, ranks))


def wordpiece_encoder(vocab: set[str]):
    tries = wordpiece_tries(vocab)
    return encoder(lambda w: wordpiece(w, tries))


def unigram_encoder(vocab: set[str]):
    trie = Trie(vocab)
    return encoder(lambda w: longest_match(w, trie))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in (x.split() for x in f if x.strip())}


def token_counter(encoding: str | None = None, ranks: str | None = None, pattern: str | None = None):
    """A size function for chunkers: tokens of a named tiktoken encoding, or of a file of ranks (on every worker) and its pattern; without
    either, words and marks. Special tokens are ordinary text."""
    from millrace.functions.text import words_and_marks

    if encoding is None and ranks is None:
        return lambda c: F.size(words_and_marks(c))
    import tiktoken

    def coder():
        return tiktoken.get_encoding(encoding) if encoding else tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})

    coder()  # what can't be loaded fails here rather than in a task

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = coder()  # once a task
        for texts in batches:
            yield texts.map(lambda t: len(held.encode_ordinary(t)) if t is not None else 0)

    return count
