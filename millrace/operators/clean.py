"""Projection, filtering and cleaning. Every function takes a DataFrame or Column and parameters; order is explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, ratio) of nulls, NaN counted as null, all columns in one pass."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        m = F.col(c).isNull()
        return m | F.isnan(c) if kinds[c] in ("double", "float") else m

    one = df.agg(*[F.avg(missing(c).cast("int")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("ratio")) for c in columns])).alias("x")).select("x.*")


def drop_sparse(df: DataFrame, limit: float = 0.30) -> DataFrame:
    """df without the columns whose missing ratio is above limit. The schema depends on data: one row of ratios is collected."""
    return df.drop(*[r["column_name"] for r in missing_ratios(df).collect() if r["ratio"] is not None and r["ratio"] > limit])


def leading_digits(c: Column) -> Column:
    """The first run of digits as a double; null without one."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("double")


def currency(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


#: Accepted date formats, in order of priority.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy.MM.dd")


def mixed_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n): rows beyond the first of each key; null keys are a key."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def search(df: DataFrame, term: str, columns: list[str], literal: bool = False) -> DataFrame:
    """Rows in which a column matches the term, case aside; null is no match. The term is a pattern unless literal."""
    if literal:
        hit = [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns]
    else:
        hit = [F.coalesce(F.col(c).rlike("(?i)" + term), F.lit(False)) for c in columns]
    return df.where(reduce(Column.__or__, hit))


def where_equal(df: DataFrame, column: str, value, every: str = "All") -> DataFrame:
    """Equality filter; the value every lets all rows through."""
    return df if value == every else df.where(F.col(column) == F.lit(value))


def passed(df: DataFrame, column: str, wanted: str = "All") -> DataFrame:
    """Filter a 0/1 flag by 'Passed', 'Failed' or 'All'."""
    return df if wanted == "All" else df.where(F.col(column) == (1 if wanted == "Passed" else 0))


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def length_above_to(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """low < length <= high, in code points."""
    return df.where((F.length(column) > low) & (F.length(column) <= high))


def one_in(df: DataFrame, column: str, n: int) -> DataFrame:
    """Every n-th row by its number in column."""
    return df.where(F.pmod(F.col(column), F.lit(n)) == 0)


def not_blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", "") != "", F.lit(False))


def valid_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the broken rules in broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def has_punch(c: Column) -> Column:
    """The gate of generated text: it holds ? or !."""
    return F.contains(c, F.lit("?")) | F.contains(c, F.lit("!"))


def preview(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def bool_label(c: Column, yes: str, no: str) -> Column:
    return F.when(c, F.lit(yes)).when(~c, F.lit(no))


def keep_or_other(c: Column, kept: list, other: str = "Other") -> Column:
    return F.when(c.isin(*kept), c).otherwise(F.lit(other))


#: Right-closed age bins and their labels; fixed values.
AGE_EDGES = (0, 12, 17, 24, 34, 50, 65, 100)
AGE_LABELS = ("Child", "Teen", "Young Adult", "Adult", "Middle Aged", "Senior", "Elderly")


def binned(c: Column, edges: tuple = AGE_EDGES, labels: tuple[str, ...] = AGE_LABELS) -> Column:
    """Labels of right-closed bins; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def weekend_label(c: Column) -> Column:
    return bool_label(F.weekday(c) >= 5, "Weekend", "Weekday")


def split_two(c: Column, by: str = ",") -> tuple[Column, Column]:
    """The trimmed parts before and behind the first delimiter; the second is null without one."""
    parts = F.split(c, by, 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def split_log(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """JSON log lines by kind: (rows with an integer step, rows whose step is a marker)."""
    step = F.get_json_object(raw, "$.step")
    marked = df.withColumn("step", step)
    number = step.try_cast("int").isNotNull()
    return marked.where(number).withColumn("step", F.col("step").cast("int")), marked.where(~number | step.isNull())


def filled(df: DataFrame, value, columns: list[str]) -> DataFrame:
    return df.na.fill(value, columns)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of names, in its order, under their new names."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def injected_nulls(df: DataFrame, column: str, share: float, seed: int = 1) -> DataFrame:
    """A generator for tests: about a share of the column's values becomes null."""
    return df.withColumn(column, F.when(F.rand(seed) >= share, F.col(column)))
