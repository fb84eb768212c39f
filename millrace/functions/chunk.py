"""Chunkers as expressions over arrays, linear in a text: paragraphs merged up to a size, small chunks joined, sections merged and split.

Sizes are counted by a pluggable function Column -> Column (default: words); lengths of merged chunks are sums of the
parts' lengths, so joining spaces aren't counted. Only the Markdown reader is Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.pieces import by_pieces
from millrace.functions.text import by_space, paragraphs, sentences, word_count

Counter = Callable[[Column], Column]
_UNIT = "struct<text:string,n:int,alone:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(units: Column) -> Column:
    """The places of an array from 0, none of an empty one."""
    return F.when(F.size(units) > 0, F.sequence(F.lit(0), F.size(units) - 1)).otherwise(F.array().cast("array<int>"))


def _from_starts(parts: Column, starts: Column, glue: str) -> Column:
    """Parts joined from each of starts up to the next: each part is copied once."""
    ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(parts))
    return F.transform(starts, lambda at, k: F.array_join(F.slice(parts, at + 1, ends(k) - at), glue))


def _greedy(units: Column, most: int) -> Column:
    """Units joined by spaces while the sum of their sizes stays within most; a unit marked alone is a chunk of its own.

    The fold keeps the places where chunks start and the size of the last one, no texts."""
    state = "struct<starts:array<int>,n:int>"  # n is null where the next unit has to start a chunk

    def made(starts: Column, n: Column) -> Column:
        return F.struct(starts.alias("starts"), n.cast("int").alias("n"))

    def step(us: Column) -> Callable[[Column, Column], Column]:
        def one(a: Column, i: Column) -> Column:
            u = F.get(us, i)
            fits = ~u["alone"] & a["n"].isNotNull() & (a["n"] + u["n"] <= most)
            return F.when(fits, made(a["starts"], a["n"] + u["n"])).otherwise(made(F.concat(a["starts"], F.array(i)), F.when(~u["alone"], u["n"])))

        return one

    def packed(us: Column) -> Column:
        starts = F.aggregate(_places(us), made(F.array().cast("array<int>"), F.lit(None)).cast(state), step(us), lambda a: a["starts"])
        return _let(F.transform(us, lambda u: u["text"]), lambda texts: _let(starts, lambda st: _from_starts(texts, st, " ")))

    return _let(units, packed)


def _unit(text: Column, n: Column, alone: Column) -> Column:
    return F.struct(text.alias("text"), n.cast("int").alias("n"), alone.alias("alone")).cast(_UNIT)


def split_oversized(paragraph: Column, most: int, count: Counter = word_count) -> Column:
    """A paragraph's sentences packed up to most; a longer sentence is chopped into runs of most words."""

    def units(s: Column) -> Column:
        n = F.ceil(F.size(by_space(s)) / most).cast("int")
        chopped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _unit(F.array_join(F.slice(by_space(s), i * most + 1, F.lit(most)), " "), F.lit(most), F.lit(True)))
        return F.when((count(s) > most) & (n > 0), chopped).otherwise(F.array(_unit(s, count(s), F.lit(False))))

    return _greedy(F.flatten(F.transform(sentences(paragraph), units)), most)


def merge_paragraphs(parts: Column, most: int, count: Counter = word_count) -> Column:
    def units(p: Column) -> Column:
        oversized = F.transform(split_oversized(p, most, count), lambda x: _unit(x, count(x), F.lit(True)))
        return F.when(count(p) > most, oversized).otherwise(F.array(_unit(p, count(p), F.lit(False))))

    return _greedy(F.flatten(F.transform(parts, units)), most)


def merge_small(chunks: Column, least: int, most: int, count: Counter = word_count) -> Column:
    """A chunk under least joins the one before it if both stay within most."""

    def merged(cs: Column) -> Column:
        def step(starts: Column, i: Column) -> Column:
            last = F.try_element_at(starts, F.lit(-1))
            before = F.array_join(F.slice(cs, last + 1, i - last), " ")  # looked at only where the chunk is small
            joins = (F.size(starts) > 0) & (count(F.get(cs, i)) < least) & (F.coalesce(count(before), F.lit(0)) + count(F.get(cs, i)) <= most)
            return F.when(joins, starts).otherwise(F.concat(starts, F.array(i)))

        return _let(F.aggregate(_places(cs), F.array().cast("array<int>"), step), lambda st: _from_starts(cs, st, " "))

    return _let(chunks, merged)


def chunks(text: Column, most: int = 600, least: int = 150, overlap: int = 0, count: Counter = word_count) -> Column:
    """Paragraph chunks of a text. An overlap isn't offered."""
    if overlap:
        raise ValueError("chunks can't overlap")
    return merge_small(merge_paragraphs(paragraphs(text), most, count), least, most, count)


SECTION = "struct<title:string,content:string>"


def _sections(text: str | None) -> Iterator[tuple[str, str]]:
    """(title, content) of the headings, underlined ones too, and the plain paragraphs under them; lists, quotes, tables and code
    are left out, with the lines that go on with them."""
    title, paras, para = "Untitled", [], []
    fence, apart = "", False  # the fence of the code we are in; whether a list, quote or table goes on

    def end_paragraph() -> None:
        if para:
            paras.append("\n".join(para))
            para.clear()

    def section() -> Iterator[tuple[str, str]]:
        end_paragraph()
        if paras:
            yield title, "\n".join(paras).strip()
            paras.clear()

    for line in (text or "").split("\n"):
        bare = line.strip()
        if fence or bare.startswith(("```", "~~~")):
            if not fence:
                end_paragraph()
                fence = bare[:3]
            elif bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            continue
        hashes = len(bare) - len(bare.lstrip("#"))
        if 1 <= hashes <= 6 and (len(bare) == hashes or bare[hashes] == " "):
            yield from section()
            title, apart = bare[hashes:].strip().rstrip("#").strip(), False
        elif not bare:
            end_paragraph()
            apart = False
        elif para and bare in ("=" * len(bare), "-" * len(bare)):
            name = " ".join(para)
            para.clear()
            yield from section()
            title = name
        elif not para and (apart or bare[0] in "-*+>|" and bare[1:2] in ("", " ") or line.startswith("    ") or not bare.strip("-*_") and len(bare) > 2):
            apart = bare.strip("-*_") != ""  # a rule is one line
        else:
            para.append(bare)
    yield from section()


class _Sections:
    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        for place, (title, content) in enumerate(_sections(text)):
            yield place, title, content


def section_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """df with place (from 0), title and content for each section of its Markdown: a table function that yields sections as it
    reads, joined laterally, so no text's sections are held together. Rows without sections go."""
    return df.lateralJoin(F.udtf(_Sections, returnType="place int, title string, content string", useArrow=True)(F.col(text).outer()))


def markdown_sections(text: Column) -> Column:
    """array<struct<title,content>> of a Markdown text."""
    return by_pieces(lambda: lambda t: list(_sections(t)), f"array<{SECTION}>", pa.list_(pa.struct([("title", pa.string()), ("content", pa.string())])))(text)


def merge_short_sections(sections: Column, least: int = 100) -> Column:
    """Sections under least words wait for the next ones; titles are joined only where a long one ends the wait."""

    def merged(ss: Column) -> Column:
        long = lambda i: word_count(F.get(ss, i)["content"]) >= least
        ends = F.filter(_places(ss), lambda i: (i == F.size(ss) - 1) | long(i))

        def section(es: Column) -> Callable[[Column, Column], Column]:
            def one(at: Column, k: Column) -> Column:
                start = F.when(k == 0, F.lit(0)).otherwise(F.get(es, k - 1) + 1)
                first, last = F.get(ss, start)["title"], F.get(ss, at)["title"]
                title = F.when((at > start) & long(at), F.concat(first, F.lit(" | "), last)).otherwise(first)
                return F.struct(title.alias("title"), F.array_join(F.transform(F.slice(ss, start + 1, at - start + 1), lambda s: s["content"]), "\n\n").alias("content"))

            return one

        return _let(ends, lambda es: F.transform(es, section(es)))

    return _let(sections, merged)


def split_long_sections(sections: Column, most: int = 1000) -> Column:
    """Sections over most words are cut at sub-headings, else at blank lines into numbered parts."""

    def cut(s: Column) -> Column:
        parts = F.split(s["content"], r"\n(?=#{1,6}\s)")
        trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

        def sub(p: Column) -> Column:
            line = F.regexp_extract(p, r"^([^\n]*)", 1)
            headed = line.rlike(r"^#{1,6}\s")
            return F.struct(
                F.when(headed, F.concat(s["title"], F.lit(" > "), trimmed(F.regexp_replace(line, "^#+", "")))).otherwise(s["title"]).alias("title"),
                F.when(headed, trimmed(F.regexp_replace(p, r"^[^\n]*", ""))).otherwise(p).alias("content"),
            ).cast(SECTION)

        by_heading = F.filter(F.transform(F.transform(parts, trimmed), sub), lambda x: word_count(x["content"]) > 0)
        by_blank = F.filter(
            F.transform(F.split(s["content"], r"\n\s*\n"), lambda p, i: F.struct(F.concat(s["title"], F.lit(" (part "), (i + 1).cast("string"), F.lit(")")).alias("title"), trimmed(p).alias("content")).cast(SECTION)),
            lambda x: x["content"] != "",
        )
        return F.when(word_count(s["content"]) <= most, F.array(s)).when(F.size(parts) > 1, by_heading).otherwise(by_blank)

    return F.flatten(F.transform(sections, cut))


def topic_sections(text: Column, least: int = 100, most: int = 1000) -> Column:
    return split_long_sections(merge_short_sections(markdown_sections(text), least), most)


def as_rows(df: DataFrame, parts: Column, key: str) -> DataFrame:
    """(key, chunk, text) with chunk from 0."""
    return df.select(key, F.posexplode(parts).alias("chunk", "text"))


def first_chunks(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("chunk") < n)


def recursive_pieces(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Cut at the first separator that occurs, pack the parts up to size characters, cut longer parts further."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    rest, out, held = separators[separators.index(sep) + 1 :], [], ""
    for part in text.split(sep):
        joined = f"{held}{sep}{part}" if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held)
        held = ""
        if len(part) > size:
            out += recursive_pieces(part, size, rest or ("",))
        else:
            held = part
    return out + ([held] if held.strip() else [])


def recursive_chunks(size: int = 1000):
    """An Arrow function text -> array<string> for the given size."""
    return by_pieces(lambda: lambda t: recursive_pieces(t or "", size), "array<string>", pa.list_(pa.string()))
