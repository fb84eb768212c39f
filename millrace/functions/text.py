"""Tokenizers and text predicates as column expressions. Classes are spelled with \\p{L} and \\p{N}: Java's \\w is ASCII only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_OR_MARK = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
#: Punctuation that the mark-keeping splitter cuts at; fixed values.
MARKS = r"([,.:;?_!\"()']|--|\s)"


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_space(c: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def words_and_marks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_OR_MARK), 1)


def alphanumeric(c: Column) -> Column:
    """White-space tokens of letters and digits only; others are dropped whole."""
    return F.filter(by_space(c), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))


def split_keeping(c: Column, separators: str) -> Column:
    """The parts between separators and the separators themselves, empty parts included, in order."""
    marked = F.regexp_replace(c, separators, "\x01$1\x01")
    return F.split(marked, "\x01")


def keeping_space(c: Column) -> Column:
    return split_keeping(c, r"(\s)")


def keeping_marks(c: Column) -> Column:
    return split_keeping(c, MARKS)


def without_blanks(c: Column) -> Column:
    """keeping_marks() without blank parts."""
    return F.filter(keeping_marks(c), lambda t: F.trim(t) != "")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda t: t != "")


def solid_characters(c: Column) -> Column:
    return F.filter(characters(c), lambda t: ~t.rlike(r"^\s$"))


def ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """Runs of n tokens, joined; an empty array where there are fewer. Each run takes its tokens by place: a slice would copy the list."""
    none = F.array().cast("array<string>")
    runs = lambda ts: F.when(F.size(ts) >= n, F.transform(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.concat_ws(separator, *[F.get(ts, i + k) for k in range(n)]))).otherwise(none)
    return F.when(tokens.isNotNull(), bound(tokens, runs)).otherwise(none)


def char_ngrams(c: Column, n: int) -> Column:
    return ngrams(characters(c), n, "")


def utf8_bytes(c: Column) -> Column:
    """The byte values of the UTF-8 form. Read as Latin-1, each byte is one character of its own value; a substring for each would
    walk there from the start."""
    chars = F.split(F.decode(c.cast("binary"), "ISO-8859-1"), "")
    return F.when(F.octet_length(c) > 0, F.transform(F.filter(chars, lambda x: x != ""), lambda x: F.ascii(x))).otherwise(F.array().cast("array<int>"))


def word_count(c: Column) -> Column:
    return F.size(by_space(c))


def sentences(c: Column) -> Column:
    """Cut after . ! ? where white space and a capital letter follow."""
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z])")


def paragraphs(c: Column) -> Column:
    """The parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


TASK_BYTES = 1 << 24  # of text whose items a task counts


def counted(df: DataFrame, items: Callable[[Column], Column], name: str, text: str = "text") -> DataFrame:
    """(name, n): how often each of items(text) occurs, in tasks of bounded size whatever the session's number of partitions.

    Texts are dealt out by their hash and counted within their part; then each item's counts meet in one of as many parts.
    Most n-grams are rare, so what a task holds follows its share of the text."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    place = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(parts)).cast("int")
    dealt = df.select(place.alias("_part"), text).repartitionById(parts, F.col("_part"))
    within = dealt.select("_part", F.explode(items(F.col(text))).alias(name)).groupBy("_part", name).agg(F.count("*").alias("n"))
    return within.select(name, "n").repartition(parts, name).groupBy(name).agg(F.sum("n").alias("n"))


def adjacent_pairs(tokens: Column) -> Column:
    """(l, r) of neighbouring tokens."""
    return bound(tokens, lambda ts: F.transform(F.slice(ts, F.lit(1), F.greatest(F.size(ts) - 1, F.lit(0))), lambda t, i: F.struct(t.alias("l"), F.get(ts, i + 1).alias("r"))))


def speaker_turns(c: Column) -> Column:
    """Lines 'Name: text' of a transcript as structs (turn, speaker, utterance)."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\w+: "))
    return F.transform(lines, lambda x, i: F.struct(i.alias("turn"), F.regexp_extract(x, r"^(\w+): (.*)$", 1).alias("speaker"), F.regexp_extract(x, r"^(\w+): (.*)$", 2).alias("utterance")))


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """<<key>> replaced by its value."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(f"<<{k}>>"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def wrapped(c: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), c, F.lit(after))
