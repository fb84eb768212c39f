"""Operator 2: quality rules. One threshold table is compiled into one Spark projection; no user functions.

Nulls and empty texts have no words and fail the base rule; texts of any length are measured whole, in one row; repeated rows are judged alike, row by row; extra columns
are carried through (a column named like a measure is replaced in the result of measures())."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, carried, let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ"
#: Frequent function words of the four languages, lower case; fixed values.
STOP_WORDS = (
    "the of and to in that is was he for it with as his on be at by this had not are but from or have an they which you were her all she there would their "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    "el que y los del las por con una para su al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """A document passes while low <= measure <= high (None: no bound)."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: The method's own threshold table; measures are columns of measures().
RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols to words", "symbol_ratio", None, 0.10),
    Rule("exclamation marks to words", "exclaim_ratio", None, 0.30),
    Rule("capital letters to characters", "upper_ratio", None, 0.40),
    Rule("repeated lines", "dup_line_ratio", None, 0.50),
    Rule("stop words", "n_stop_words", 1, None),
)


def _removed(text: Column, chars: str) -> Column:
    """How many characters of the set the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of that many words that occur twice or more, counted once each, in O(n log n)."""

    def covered(hashes: Column) -> Column:
        twin = F.filter(
            hashes,
            lambda x, i: F.coalesce(F.get(hashes, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(hashes, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(
            F.array_sort(F.transform(twin, lambda x: x["p"])),
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(ps, i + 1) - p, F.lit(window)))),
                F.lit(0).cast("int"),
                lambda a, x: a + x,
            ),
        )

    n = F.size(ws)
    spans = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(F.xxhash64(F.slice(ws, i + 1, window)).alias("h"), i.alias("p")))
    return F.when(n > window, let(F.array_sort(spans), covered)).otherwise(F.lit(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of each whole text as columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    stops = F.array(*[F.lit(x) for x in STOP_WORDS])
    # One let-binding of the words serves every word measure.
    by_word = let(
        words(F.col(text)),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            repeated_words(ws).alias("n_repeat_words"),
            F.size(F.array_intersect(F.slice(ws, 1, F.greatest(F.size(ws), F.lit(1))), stops)).cast("long").alias("n_stop_words"),
        ),
    )
    out = docs.withColumn("_w", by_word).withColumns(
        {
            "word_chars": (F.length(t) - _removed(t, SPACES)).cast("long"),
            "n_symbols": _removed(t, SYMBOLS).cast("long"),
            "n_dup_lines": repeated_lines(F.col(text)),
            "_upper": _removed(t, UPPER),
            "_exclaim": _removed(t, "!"),
            "_lines": F.length(t) - F.length(F.translate(t, "\n", "")) + 1,
        }
    )
    per_word = F.greatest(F.col("_w.n_words"), F.lit(1))
    return out.withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
            "n_stop_words": F.col("_w.n_stop_words"),
            "mean_word_chars": F.col("word_chars") / per_word,
            "symbol_ratio": F.col("n_symbols") / per_word,
            "exclaim_ratio": F.col("_exclaim") / per_word,
            "upper_ratio": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.col("_lines"),
        }
    ).drop("_w", "_upper", "_exclaim", "_lines")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.measure) >= r.low)
        if r.high is not None:
            verdict = verdict & (F.col(r.measure) <= r.high)
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """docs with measures, base_failed and kept."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return judged(docs.select("text", carried(docs)), rules).where("kept").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def quality_digest(docs: DataFrame) -> DataFrame:
    """The query's columns for each row of docs."""
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
