"""Packing and binary output against brute force, by the library's own ids of whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import binary_tokens as B
from millrace.llm import packing as P
from millrace.llm import tokens as T
from millrace.llm.tokens import Encoder, default_path

ODD = ["", " ", "a  b", "a \n b", "x  y", "tab\t tab", "a\0b c", " lead", "trail ", "it's 'quoted' 12 34", "日本 語　 x", "é" * 300, "<|endoftext|> z", "  q  ", "a \x1c b"]


def whole(text: str) -> list[int]:
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    assert [x.tolist() for x in Encoder(default_path()).ids(ODD)] == [whole(t) for t in ODD]


CODER, LIBRARY = Encoder(default_path()), Tokenizer.from_file(default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,!ab'1\u00e9\u2003\u00a0\x85\u65e5\x1c\u00bb", max_size=14), max_size=4))
def test_encoder_on_white_space(texts):
    assert [x.tolist() for x in CODER.ids(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_when_its_table_is_full(monkeypatch):
    monkeypatch.setattr(T, "ARENA", 60)
    coder = Encoder(default_path())
    for i in range(12):
        texts = [f"word{i}x other{i} stuff, more{k} stuff" for k in range(3)]
        assert [x.tolist() for x in coder.ids(texts)] == [whole(t) for t in texts]


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_new_pieces_go_to_the_library_together():
    coder = Encoder(default_path())
    coder.tokenizer = Counting(coder.tokenizer)
    texts = [" ".join(f"w{i}{chr(97 + k % 26)}ö$ 7{k}  x" for k in range(50)) + end for i, end in enumerate(["", " ", "  ", "\n", " \u2003", ",", "\n\n x", " é"] * 10)]
    assert [x.tolist() for x in coder.ids(texts)] == [whole(t) for t in texts]
    assert coder.tokenizer.texts < 500  # of 5,000 pieces that are new
    for odd in (b"\xff\xfe", b"\xe3\x81", b"\x80", b"\xc3"):  # broken UTF-8, at the end of a piece or within
        raw = [b"some new" + odd + b" words" + odd + b"x here" + odd, b" and odd" + odd]
        got = coder.ids_of(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
        assert [x.tolist() for x in got] == [whole(t.decode("utf-8", "replace")) for t in raw]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,!ab'1\u00e9\u2003\u00a0\x85\u65e5\x1c\u00bb", max_size=40), min_size=1, max_size=6))
def test_encoder_without_a_table(texts):
    CODER._clear()
    assert [x.tolist() for x in CODER.ids(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        open_ = [i for i, r in enumerate(bins) if r >= n]
        if open_:
            bins[min(open_, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_runs_are_best_fit_decreasing(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    used, places = {}, set()
    for n, low, high, first, each, at in P.best_fit_runs(hist, 24):
        for r in range(low, high):
            b, o = first + (r - low) // each, at + (r - low) % each * n
            for x in range(o, o + n):
                assert (b, x) not in places
                places.add((b, x))
            used[b] = used.get(b, 0) + n
    assert sum(used.values()) == sum(lengths)
    assert sorted(24 - v for v in used.values()) == brute_best_fit(lengths, 24)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "y"), (101, "word " * 5000, None), (205, "twice", "z"), (205, "twice", "z"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def expected(rows, end):
    return sorted((-1 if r.doc_id is None else r.doc_id, tuple(whole(r.text) + [end])) for r in rows)


def test_packing(spark, docs):
    got = P.packed_documents(docs).collect()
    assert len(got) == sum(-(-len(i) // 2048) for _, i in expected(docs.collect(), 0))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for xs in by.values():
        at = 0
        for o, n in sorted(xs):
            assert o == at
            at += n
        assert at <= 2048
    long_ = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 101)
    ids = np.array(whole("word " * 5000) + [0], "<u4")
    at = 0
    for k, (p, s, n, c) in enumerate(long_):
        assert (p, s, c) == (k, at, zlib.crc32(ids[at : at + n].tobytes())) and (n == 2048 or k == 0)
        at += n
    assert at == len(ids)
    assert P.packed_documents(docs.limit(0)).count() == 0


def test_binary_round_trip(spark, docs):
    want = expected(docs.collect(), 2)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in B.binary_digest(docs).collect())
    assert [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want] == [(d, n, c) for d, _, n, c in got]
    assert [s for _, s, _, _ in got] == np.concatenate([[0], np.cumsum([len(i) for _, i in want])])[:-1].tolist()
    assert B.binary_digest(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400), st.integers(0, 50))
def test_re_pair_random_access(ids, start, n):
    ids = np.array(ids, np.uint16)
    s = B.Shard(B.packed_shard([1], [len(ids)], ids))
    assert s.all_ids().tolist() == ids.tolist()
    start = min(start, len(ids))
    n = min(n, len(ids) - start)
    assert s.ids(start, n).tolist() == ids[start : start + n].tolist()


def unfolded(symbols, rules, base):
    out = list(symbols)
    while any(x >= base for x in out):
        out = [y for x in out for y in (rules[x - base] if x >= base else [x])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.sampled_from([2, 3, 5]))
def test_re_pair_leaves_no_frequent_pair(ids, least):
    symbols, rules = B.re_pair(np.array(ids, np.uint32), 5, least)
    symbols, rules = symbols.tolist(), rules.tolist()
    assert unfolded(symbols, rules, 5) == ids
    met, free = {}, {}
    for i, p in enumerate(zip(symbols, symbols[1:])):
        if free.get(p, 0) <= i:  # without overlap
            met[p], free[p] = met.get(p, 0) + 1, i + 2
    assert all(n < least for n in met.values())
    # Each rule was worth its cost when it was made: it is used that often by the symbols and by later rules.
    assert all(sum(x == 5 + k for x in symbols) + sum(x == 5 + k for r in rules for x in r) >= 1 for k in range(len(rules)))


def test_re_pair_beyond_16_bits():
    r = np.random.default_rng(5)
    words = r.integers(0, 70_000, (9000, 3))
    ids = words[r.integers(0, 9000, 120_000)].ravel().astype(np.uint32)
    s = B.Shard(B.packed_shard([7, None], [5, len(ids) - 5], ids, 70_001))
    assert len(s.symbols) < len(ids) / 2 and np.array_equal(s.all_ids(), ids) and s.null.tolist() == [0, 1]
    for at in r.integers(0, len(ids) - 50, 40).tolist():
        assert np.array_equal(s.ids(at, 50), ids[at : at + 50])
    with pytest.raises(ValueError):
        B.packed_shard([1], [1], np.array([9], np.uint32), 9)


def test_equal_doc_ids_rerun_alike(spark):
    rows = [(1, f"text {i % 40}") for i in range(200)] + [(None, f"null {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((r.start, r.n_tokens, r.ids_crc32) for r in B.binary_digest(df.repartition(n, F.lit(n), "text")).collect()) for n in (1, 3)]
    assert runs[0] == runs[1]
