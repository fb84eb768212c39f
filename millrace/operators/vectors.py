"""Vectors: quantisation, exact search, pooling. Arithmetic on arrays stays in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import nearest


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """a over its length; the zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def bits(a: Column) -> Column:
    """1 where a component is above 0."""
    return F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0))


def words_of_bits(a: Column) -> Column:
    """The bits packed into 64-bit words, first component in the highest bit, zero padded."""
    b = bits(a)
    return F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(a) / 64).cast("int") - 1),
        lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.coalesce(F.get(b, w * 64 + i), F.lit(0)).cast("long"))),
    )


def packed_bytes(a: Column) -> Column:
    """The bits as bytes, eight components each, the first in the highest bit, zero padded."""
    b = bits(a)
    eight = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 8).cast("int") - 1), lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, i: acc * 2 + F.coalesce(F.get(b, k * 8 + i), F.lit(0))))
    return F.unhex(F.array_join(F.transform(eight, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def hamming_top(rows: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", hot: int = 4096) -> DataFrame:
    """(query_id, vec_id, distance, score, rank) by bits, exactly, by multi-index hashing; words are packed once a row."""
    bits_ = rows.agg(F.max(F.size(vector))).first()[0] or 1
    q = queries.select(F.col(id_).alias("query_id"), words_of_bits(F.col(vector)).alias("v"))
    r = rows.select(F.col(id_).alias("row_id"), words_of_bits(F.col(vector)).alias("v"))
    out = nearest.multi_index_top(r, q, k, bits_, hot)
    return out.select("query_id", F.col("row_id").alias(id_), F.col("distance").cast("int").alias("distance"), similarity(F.col("distance")).alias("score"), "rank")


def cosine_top(rows: DataFrame, queries: DataFrame, k: int = 3, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, cosine, rank) by the cosine to six places, exactly, in blocks."""
    q = queries.select(F.col(id_).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    r = rows.select(F.col(id_).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    out = nearest.block_top(r, q, k, nearest.cosine_distance)
    return out.select("query_id", F.col("row_id").alias(id_), (-F.col("distance") + F.lit(0.0)).alias("cosine"), "rank")


def mean_pooled(df: DataFrame, key: str, vector: str, scale: int = 6) -> DataFrame:
    """(key, pooled): componentwise means, rounded."""
    one = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg((F.round(F.avg(F.col("x").cast("double")), scale) + 0.0).alias("m"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pooled"))


def projection(weights: list[list[float]]):
    """A pandas UDF for a fixed linear map: weights has one row an output component."""
    import numpy as np

    w = np.asarray(weights, np.float64)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ w.T)) if len(v) else pd.Series([], dtype=object)

    return run


def embedder(model, batch: int = 512):
    """The boundary of embedding models: model(list of texts) -> list of vectors, in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            out += list(model(texts.iloc[at : at + batch].tolist()))
        return pd.Series(out)

    return run


def context(hits: DataFrame, query: str, rank: str, text: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """(query, context): the texts of a query's hits in the order of rank."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return hits.groupBy(query).agg(F.array_join(F.transform(rows, lambda x: x["t"]), separator).alias("context"))


def prompt(question: Column, found: Column) -> Column:
    """A question over its context; a message stands in for a missing one."""
    ctx = F.coalesce(F.nullif(found, F.lit("")), F.concat(F.lit("No context available for query: "), question))
    return F.concat(F.lit("Context:\n"), ctx, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def collection(df: DataFrame, name: str) -> None:
    """Create a vector table, the old one dropped."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.saveAsTable(name)
