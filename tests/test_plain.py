"""Queries that SQL can't say, against plain Python over whole tables."""

import hashlib
import re
import time
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from millrace.functions import chunk, metrics, subword
from millrace.queries import registry
from tests.test_operators import plain_bpe, plain_wordpiece


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def space(text):
    return [w for w in re.split(r"\s+", text, flags=re.ASCII) if w]


def packed(units, most):
    """Units (text, size, alone) joined while their sizes sum to most at most."""
    out, held, size = [], [], 0
    for text, n, alone in units:
        if held and (alone or size + n > most):
            out.append(" ".join(held))
            held, size = [], 0
        if alone:
            out.append(text)
        else:
            held, size = held + [text], size + n
    return out + ([" ".join(held)] if held else [])


def plain_chunks(text, most, least):
    units = []
    for p in re.split(r"\n\s*\n", text, flags=re.ASCII):
        p = re.sub(r"^\s+|\s+\Z", "", p, flags=re.ASCII)
        if not p:
            continue
        if len(space(p)) <= most:
            units.append((p, len(space(p)), False))
            continue
        cut = []
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p, flags=re.ASCII):
            words = space(s)
            if len(words) > most:
                cut += [(" ".join(words[i : i + most]), most, True) for i in range(0, len(words), most)]
            else:
                cut.append((s, len(words), False))
        units += [(x, 0, True) for x in packed(cut, most)]
    out = []
    for c in packed(units, most):
        if out and len(space(c)) < least and len(space(out[-1])) + len(space(c)) <= most:
            out[-1] += " " + c
        else:
            out.append(c)
    return out


def test_chunk_tokens(spark, sf, docs):
    want = {(d, i, c) for d, t in docs.items() if t is not None for i, c in enumerate(plain_chunks(t.replace("\n", "\n\n"), 60, 15))}
    assert {(r.doc_id, r.chunk, r.text) for r in rows(spark, sf, "chunk_tokens")} == want
    assert {(r.doc_id, r.chunk, r.text) for r in rows(spark, sf, "first_two_chunks")} == {w for w in want if w[1] < 2}


def test_recursive_split_keeps_all(spark, sf, docs):
    got = {}
    for r in sorted(rows(spark, sf, "recursive_split"), key=lambda r: (r.doc_id, r.chunk)):
        assert 0 < len(r.text) <= 500
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    bare = lambda t: "".join((t or "").split())
    assert {d: bare(t) for d, t in got.items()} == {d: bare(t) for d, t in docs.items() if bare(t)}


def test_unigram_is_longest_match(spark, sf, docs):
    counts = Counter(w for t in docs.values() if t for w in space(t))
    vocab = set(sorted(counts, key=lambda w: (-counts[w], w))[:2000])
    sizes = {r.doc_id: r.n for r in rows(spark, sf, "unigram")}
    for d, t in docs.items():
        n = 0
        for w in (t or "").split():
            while w:
                n, w = n + 1, w[next((k for k in range(len(w), 0, -1) if w[:k] in vocab), 1) :]
        assert t is None or sizes[d] == n


def test_encoders_keep_the_text(spark, sf, docs):
    """The encoders' rows over the trained vocabularies: pieces join to the words again."""
    words = {r["word"]: r["n"] for r in subword.word_counts(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert words == Counter(w for t in docs.values() if t for w in space(t))
    ranks = {p: i for i, p in enumerate(plain_bpe(words, 100))}
    tries = subword.wordpiece_tries(plain_wordpiece(words, 160))
    for w in words:
        assert "".join(subword.bpe_symbols(w, ranks)) == w + subword.END
        assert "".join(x.removeprefix("##") if i else x for i, x in enumerate(subword.wordpiece(w, tries))) == w or "#" in w
    pieces = {r.doc_id: (r.n, r.tokens) for r in rows(spark, sf, "wordpiece_encode")}
    for d, t in docs.items():
        if t is not None:
            made = [x for w in t.split() for x in subword.wordpiece(w, tries)]
            assert pieces[d] == (len(made), hashlib.md5("|".join(made).encode()).hexdigest()), d
    counted = {r.doc_id: r.n for r in rows(spark, sf, "bpe_encode")}
    assert all(counted[d] == sum(len(subword.bpe_symbols(w, ranks)) for w in t.split()) for d, t in docs.items() if t is not None)


def test_rouge(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r)
    got = {(r.conv_id, r.turn): (r.rouge1, r.rouge2, r.rougeL) for r in rows(spark, sf, "rouge_scores")}
    want = {}
    for c, ts in turns.items():
        for before, r in zip([None, *ts], ts):
            if r.role == "assistant":
                a, b = metrics.tokens(r.text), metrics.tokens(before.text if before else None)

                @lru_cache(None)
                def lcs(i, j):
                    return 0 if not i or not j else lcs(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(lcs(i - 1, j), lcs(i, j - 1))

                for i in range(0, len(a), 100):  # shallow recursion
                    lcs(i, len(b))
                grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
                f1 = lambda n, x, y: round(2 * n / (x + y), 6) if n else 0.0
                both = [f1((grams(a, n) & grams(b, n)).total(), grams(a, n).total(), grams(b, n).total()) for n in (1, 2)]
                want[c, r.turn] = (*both, f1(lcs(len(a), len(b)), len(a), len(b)))
    assert got == want


def plain_sections(text):
    """The sections of texts whose lines are all apart: a block is one line."""
    lines, out, title, held, fence = (text or "").split("\n"), [], "Untitled", [], None
    for i, line in enumerate(lines):
        heads = [] if i % 5 else [f"# {line[:40]}"]
        for block in [*heads, line]:
            b = block.strip()
            if fence:
                fence = None if b and not b.replace(fence, "") and len(b) >= 3 else fence
            elif b.startswith(("```", "~~~")):
                fence = b[0]
            elif re.match(r"#{1,6}( |$)", b):
                out += [(title, "\n".join(held))] if held else []
                title, held = re.sub(r"#+$", "", b.lstrip("#").strip()).strip(), []
            elif b and not (re.match(r"[-*+>|]( |$)", b) or block.startswith("    ") or re.fullmatch(r"[-*_]{3,}", b)):
                held.append(b)
    return out + ([(title, "\n".join(held).strip())] if held else [])


def plain_topics(sections, least, most):
    merged, wait = [], None
    for title, content in sections:
        short = len(space(content)) < least
        wait = (title, content) if wait is None else (wait[0] if short else f"{wait[0]} | {title}", f"{wait[1]}\n\n{content}")
        if not short:
            merged.append(wait)
            wait = None
    out, strip = [], lambda x: re.sub(r"^\s+|\s+\Z", "", x, flags=re.ASCII)
    for title, content in merged + ([wait] if wait else []):
        parts = re.split(r"\n(?=#{1,6}\s)", content, flags=re.ASCII)
        if len(space(content)) <= most:
            out.append((title, content))
        elif len(parts) > 1:
            for p in map(strip, parts):
                line = p.split("\n")[0]
                one = (f"{title} > {strip(line.lstrip('#'))}", strip(p[len(line) :])) if re.match(r"#{1,6}\s", line, flags=re.ASCII) else (title, p)
                out += [one] if space(one[1]) else []
        else:
            out += [(f"{title} (part {i + 1})", strip(p)) for i, p in enumerate(re.split(r"\n\s*\n", content, flags=re.ASCII)) if strip(p)]
    return out


def test_chunk_topics(spark, sf, docs):
    got = {}
    for r in rows(spark, sf, "chunk_topics"):
        got.setdefault(r.doc_id, {})[r.chunk] = (r.title, r.content)
    for d, text in docs.items():
        assert [x for _, x in sorted(got.get(d, {}).items())] == plain_topics(plain_sections(text), 30, 120), d


def test_markdown_rows(spark, sf, docs):
    got = {}
    for r in rows(spark, sf, "markdown_rows"):
        got.setdefault(r.doc_id, {})[r.place] = (r.title, r.content)
    for d, text in docs.items():
        assert [x for _, x in sorted(got.get(d, {}).items())] == [(t, hashlib.md5(c.encode()).hexdigest()) for t, c in plain_sections(text)], d


MARKDOWN = """before
all

Under lined
===========
first para
goes on

- item
goes on with the item

after the list
---
Second, by dashes above? no: "after the list" is the heading

```python
# not a heading
```
~~~
``` still code
# nor this
~~~
> quote
and its lazy line

***

| a | b |

    indented code

### Third ###
text

# Empty

## Last
end"""


def test_markdown_blocks(spark):
    want = [("Untitled", "before\nall"), ("Under lined", "first para\ngoes on"), ("after the list", 'Second, by dashes above? no: "after the list" is the heading'), ("Third", "text"), ("Last", "end")]
    assert list(chunk._sections(MARKDOWN)) == want
    df = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, ""), (4, "plain")], "id int, text string")
    got = chunk.section_rows(df).orderBy("id", "place").collect()
    assert [(r.id, r.place, r.title, r.content) for r in got] == [(1, i, t, c) for i, (t, c) in enumerate(want)] + [(4, 0, "Untitled", "plain")]
    assert [tuple(x) for x in df.where("id = 1").select(chunk.markdown_sections(F.col("text")).alias("s")).first().s] == want


def test_long_texts_are_chunked_in_linear_time(spark):
    text = " ".join(f"word{i % 977}" + (". Next" if i % 13 == 0 else "") + ("\n\n" if i % 200 == 0 else "") for i in range(150_000))
    got = spark.createDataFrame([(text,)], "text string").select(chunk.chunks(F.col("text"), 600, 150).alias("c")).first().c
    assert got == plain_chunks(text, 600, 150)


def test_rank_token_counts(spark, sf, docs):
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=subword.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: r.n for r in rows(spark, sf, "rank_token_counts")} == {d: len(coder.encode_ordinary(t or "")) for d, t in docs.items()}


def test_common_subsequences():
    r = np.random.default_rng(12)
    for _ in range(200):
        a, b = ([str(x) for x in r.integers(0, 4, r.integers(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert metrics.lcs(a, b) == row[-1]
    long_ = [[f"w{x}" for x in r.integers(0, 3000, 20_000)] for _ in range(2)]
    began = time.time()
    assert metrics.lcs(*long_) > 300 and time.time() - began < 10


def test_pieces_of_a_batch():
    """Slices in order that are together the batch, each of bounded size unless one text is longer."""
    from millrace.functions.pieces import pieces

    texts = ["é" * 30, None, "", "x" * 500, *["ab c"] * 200]
    some = [p.to_pylist() for p in pieces(pa.array(texts).slice(1), 100)]
    assert sum(some, []) == texts[1:] and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100 for p in some)
    assert [p.to_pylist() for p in pieces(pa.array(texts[3:4]), 10)] == [texts[3:4]] and list(pieces(pa.array([], pa.string()))) == []


def test_encoders_hold_a_piece_of_a_batch():
    """What leaves an encoder for one large batch are many small arrays."""
    out = list(subword.unigram_encoder({"word", "oth"}).func(iter([pa.array(["word other " * 5_000] * 60)])))
    assert sum(map(len, out)) == 60 and max(map(len, out)) <= 20
    assert all(x == ["word", "oth", "e", "r"] * 5_000 for a in out for x in a.to_pylist())


def test_word_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(subword, "KEPT", 3)
    asked = []
    run = subword.encoder(lambda w: asked.append(w) or [w])
    (out,) = run.func(iter([pa.array(["a a b", None, "c a d a"])]))
    assert out.to_pylist() == [["a", "a", "b"], None, ["c", "a", "d", "a"]] and asked == ["a", "b", "c", "d", "a"]
