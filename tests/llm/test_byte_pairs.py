"""Byte-level BPE by segment trees against the tiktoken library and against a quadratic merge."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import byte_pairs as B
from millrace.llm import tokens as T

PATH = B.default_path()
CODER = B.RankEncoder(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,!ab'1stlé  \x85日\x1c»​　٣½😀́", max_size=40), max_size=4))
def test_equals_the_library(texts):
    assert [x.tolist() for x in CODER.ids(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_equals_the_library_on_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [x.tolist() for x in CODER.ids(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_pieces_are_bytes_and_may_be_broken():
    """What Encoder hands over and takes back, and the texts of it."""
    pieces = [b"don't", b" 1st", b"\n", b" a \xff\xfe", b" \xe3\x81", b"\xf0\x9f\x98\x80"]
    flat, first, n = CODER._encoded(pieces)
    assert [flat[a : a + k].tolist() for a, k in zip(first, n)] == [LIBRARY.encode_ordinary(p.decode("utf-8", "replace")) for p in pieces]
    for odd in (b"\xff\xfe", b"\xe3\x81", b"\x80", b"\xc3"):
        raw = [b"some new" + odd + b" words" + odd + b"x here" + odd, b"", b" and odd" + odd]
        got = CODER.ids_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        assert [x.tolist() for x in got] == [LIBRARY.encode_ordinary(r.decode("utf-8", "replace")) for r in raw]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,!ab'1stlé  \x85日\x1c»​　٣½😀́", max_size=40), min_size=1, max_size=6))
def test_without_a_table(texts):
    CODER._clear()
    assert [x.tolist() for x in CODER.ids(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(T, "ARENA", 60)
    coder = B.RankEncoder(PATH)
    for i in range(12):
        texts = [f"word{i}x other{i} stuff, more{k} stuff" for k in range(3)]
        assert [x.tolist() for x in coder.ids(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def plain(piece, ranks):
    """Merges the leftmost of the least ranks until no pair is a token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=2, max_size=6), max_size=20, unique=True), st.lists(st.text(alphabet="abc", min_size=1, max_size=40), min_size=1, max_size=5))
def test_any_ranks(tokens, pieces):
    """Vocabularies no training has made: ties, tokens out of reach, long before short."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
    r, blobs = B.Ranks(ranks), [p.encode() for p in pieces]
    want = [plain(p, ranks) for p in blobs]
    assert [r.alone(p) for p in blobs] == want and list(r.together(blobs, 64)) == want
    assert r.merged(blobs) == [[ranks[p]] if p in ranks else w for p, w in zip(blobs, want)]


@pytest.mark.parametrize("n", [127, 128, 129, 5000])
def test_long_matches(n):
    r = random.Random(n)
    for letters in ("ab", "etaoinshrdlu", "éà日本"):
        text = "".join(r.choice(letters) for _ in range(n))
        assert CODER.ids([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_a_very_long_match_takes_seconds():
    text = "".join(random.Random(1).choices("abcdefgh", k=300_000))
    ids = CODER.ids([text])[0]
    assert len(ids) < 300_000 and CODER.ranks.decoded(ids)[0].tobytes().decode() == text


def test_odd_rows(spark, docs, rows):
    extra = [(500, "<|endoftext|> z\0 " + "x" * 3000), (501, "tab\t\ttab  \n\n  \r\n end "), (502, "y" * 200 + " don't I'LL we've"), (502, "y" * 200 + " don't I'LL we've")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("ids", F.lit("clash"))
    want = []
    for doc, text in [(r[0], r[1]) for r in rows] + extra:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted([tuple(r) for r in B.round_trip_digest(df).collect()], key=str) == sorted(want, key=str)
    assert B.round_trip_digest(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: LIBRARY.encode_ordinary(r.text or "") for r in docs.collect()}
    ids = B.encoded(docs)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in ids.collect()} == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: bytes(r.ids).decode() for r in B.decoded(ids).collect()} == {d: t or "" for d, t in texts.items()}
