"""Queries of the vector operators over embeddings; searches take every 100th row as a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import vectors
from millrace.queries.registry import query


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::INT AS ones, array_to_string(list_transform(embedding, lambda x: (x > 0)::INT), '') AS bits FROM embeddings")
def quantize_bits(t, spark):
    return t("embeddings").select("vec_id", vectors.bits(F.col("embedding")).alias("b")).select("vec_id", F.aggregate("b", F.lit(0), lambda a, x: a + x).alias("ones"), F.array_join(F.col("b").cast("array<string>"), "").alias("bits"))


@query("SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda k: printf('%02X', list_sum(list_transform(range(0, 8), lambda i: (embedding[k * 8 + i + 1] > 0)::INT * (1 << (7 - i)::INT)))::INT)), '') AS packed FROM embeddings")
def pack_bits(t, spark):
    return t("embeddings").select("vec_id", F.hex(vectors.packed_bytes(F.col("embedding"))).alias("packed"))


_H = "list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (r.embedding[i] > 0))::INT))::INT"


@query(f"SELECT query_id, vec_id, distance, 1.0::DOUBLE / (1 + distance) AS score, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, {_H} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_H}, r.vec_id)::INT AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def hamming_topk(t, spark):
    e = t("embeddings")
    return vectors.hamming_top(e, e.where("vec_id % 100 = 0"), 5)


_U = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings"
_C = "round(list_sum(list_transform(range(1, 65), lambda i: q.e[i] * r.e[i])), 6)"


@query(f"WITH u AS ({_U}) SELECT query_id, vec_id, cosine, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, {_C} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_C} DESC, r.vec_id)::INT AS rank FROM u q, u r WHERE q.vec_id % 100 = 0) WHERE rank <= 3")
def cosine_topk(t, spark):
    e = t("embeddings")
    return vectors.cosine_top(e, e.where("vec_id % 100 = 0"), 3)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def l2_norm(t, spark):
    return t("embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@query("SELECT label, i::INT AS i, round(avg(x), 4) + 0.0 AS m FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def mean_pool(t, spark):
    return vectors.mean_pooled(t("embeddings"), "label", "embedding", 4).select("label", F.posexplode("pooled").alias("i", "m"))


@query(f"""WITH u AS ({_U}), h AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_C} DESC, r.vec_id)::INT AS rank FROM u q, u r WHERE q.vec_id % 100 = 0),
c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN benchmark ON vec_id % (SELECT count(*) FROM benchmark) = item_id WHERE rank <= 3 GROUP BY 1)
SELECT e.vec_id AS query_id, 'Context:' || chr(10) || coalesce(nullif(context, ''), 'No context available for query: query ' || e.vec_id) || chr(10) || chr(10) || 'Question: query ' || e.vec_id || chr(10) || 'Answer:' AS prompt FROM embeddings e LEFT JOIN c ON e.vec_id = c.query_id WHERE e.vec_id % 50 = 0""")
def rag_prompts(t, spark):
    e, b = t("embeddings"), t("benchmark")
    hits = vectors.cosine_top(e, e.where("vec_id % 100 = 0"), 3)
    texts = b.select(F.col("item_id").alias("_i"), F.col("text").alias("passage"))
    n = b.agg(F.count("*").alias("n"))
    found = hits.crossJoin(n).join(texts, F.pmod("vec_id", F.col("n")) == F.col("_i"))
    ctx = vectors.context(found, "query_id", "rank", "passage")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("q"))
    return asked.join(ctx, "query_id", "left").select("query_id", vectors.prompt(F.col("q"), F.col("context")).alias("prompt"))


@query("""SELECT vec_id, j::INT AS i, round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * CASE WHEN (i + j) % 7 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END)), 5) + 0.0 AS x
FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS j FROM embeddings)""")
def projected(t, spark):
    weights = [[(1.0 if (i + j) % 7 == 0 else -0.5) for i in range(64)] for j in range(8)]
    return t("embeddings").select("vec_id", F.transform(vectors.projection(weights)(F.col("embedding")), lambda x: F.round(x, 5) + 0.0).alias("p")).select("vec_id", F.posexplode("p").alias("i", "x"))
