"""Operator 11: Merkle manifest of a dataset.

Each row is a leaf, the SHA-256 of its encoded columns. The leaves of a source, in order of doc_id, form a tree of runs of
16; the sources' roots, in order of source, form one more tree of the same kind over them. Two passes over persisted
levels do all the work. Bottom-up: a level's runs are a grouping of the level below by (tree, place / 16), so no task ever
holds more than 16 nodes of a tree, however many rows a source has. Top-down: a level's runs are joined with the proof
suffixes of their parents, and each child prepends its siblings to the suffix that it inherits. A suffix travels once for
a run of 16, and whole proofs only exist where a leaf's row leaves the last join.

Places come from ranges of the whole order (source, doc_id, leaf), numbered apart and shifted, so that a source is never
in one task. The driver learns one number, the greatest count of leaves of a source, for the height.

Null columns are encoded as "-" (an empty text is "0:"); a null source is a source, before all others; a null doc_id comes
first in its source and is never tampered with. Repeated rows are leaves of their own, next to each other. A source of one
row has its leaf as its root; an empty table gives no rows. Texts of any length are hashed whole; other columns than the
five are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import written

FANOUT = 16
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]  # in the order of the encoding
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The digest of the values: each its UTF-8 length, a colon and itself, or a dash if it is null."""
    text = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with part (a number for each group, in the groups' order), nth (its place in the group, from 0) and n (rows of
    the group). Ranges of the whole order are numbered apart, then shifted by what the ranges before hold of the group."""
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    cut = written(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "merkle-ranges")
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    counts = cut.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))  # a row for each range and group in it
    shifts = counts.select(
        F.col("_range").alias("_r"),
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.min("_first").over(w).alias("part"),
        (F.sum("_c").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c") - F.col("_first")).alias("_shift"),
        F.sum("_c").over(w).alias("n"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return cut.join(shifts, same).withColumn("nth", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_r", "_shift", *[f"_g{i}" for i in range(len(group))])


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """(part, run, n, kids, digest) of nodes (part, nth, n, node, own); a lone node is its own run and keeps its digest."""
    kids = F.sort_array(F.collect_list(F.struct("nth", "node", "own")))  # FANOUT at most
    grouped = nodes.groupBy("part", F.floor(F.col("nth") / FANOUT).cast("long").alias("run"), "n").agg(kids.alias("kids"))
    made = F.when(F.col("n") == 1, F.col("kids")[0]["node"]).otherwise(F.sha2(F.array_join(F.col("kids.node"), ""), 256))
    return written(grouped.withColumn("digest", made), f"merkle-level{level}")


def built(nodes: DataFrame) -> list[DataFrame]:
    """The persisted levels of runs over nodes (part, nth, n, node, own), the lowest first; trees that have ended are in none above."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [_runs(nodes, 1)]
    while (most := -(-most // FANOUT)) > 1:
        below = levels[-1].where(F.col("n") > FANOUT)
        up = below.select("part", F.col("run").alias("nth"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.col("digest").alias("node"), F.lit(None).cast("int").alias("own"))
        levels.append(_runs(up, len(levels) + 1))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(part, level, digest) of the run that ends each tree."""
    ends = [x.where(F.col("n") <= FANOUT).select("part", F.lit(i).alias("level"), "digest") for i, x in enumerate(levels)]
    out = ends[0]
    for x in ends[1:]:
        out = out.union(x)
    return out


STEP = "struct<left:string,right:string>"


def pushed(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The proofs of all nodes of the lowest level, as (own, node, path, known): tops (part, level, path, known) start at
    each tree's end with what they inherit, and each level's children prepend their siblings to it."""
    suffixes = None
    for i in reversed(range(len(levels))):
        start = tops.where(F.col("level") == i).select("part", F.lit(0).cast("long").alias("run"), "path", "known")
        suffixes = start if suffixes is None else suffixes.union(start)
        ids = F.col("kids.node")
        kids = F.transform(
            "kids",
            lambda x, k: F.struct(
                x["nth"].alias("run"),
                x["own"].alias("own"),
                x["node"].alias("node"),
                F.struct(F.array_join(F.slice(ids, F.lit(1), k), "").alias("left"), F.array_join(F.slice(ids, k + 2, F.lit(FANOUT)), "").alias("right")).alias("step"),
            ),
        )
        own = F.when(F.col("n") == 1, F.array().cast(f"array<{STEP}>")).otherwise(F.array("kid.step"))
        out = levels[i].select("part", "run", "n", kids.alias("kids")).join(suffixes, ["part", "run"]).select("part", "n", "known", "path", F.explode("kids").alias("kid"))
        out = out.select("part", "kid.run", "kid.own", "kid.node", F.concat(own, "path").alias("path"), "known")
        if i:
            suffixes = written(out.select("part", "run", "path", "known"), f"merkle-proofs{i}")
    return out.select("own", "node", "path", "known")


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, node, any others) with known (root, subroot) and path, the proof: array of (left, right) siblings, upwards."""
    spark = leaves.sparkSession
    order = written(leaves.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")  # equal rows can lie in several ranges
    places = ranked(order, ["source"], ["doc_id", "node", "_tie"])
    low = built(places.select("part", "nth", "n", "node", F.struct(*[F.col(f"`{c}`") for c in leaves.columns if c != "node"]).alias("own")))
    ends = written(roots(low).withColumnsRenamed({"part": "tree", "digest": "node"}), "merkle-subroots")
    tree = ranked(ends, [], ["tree"])
    high = built(tree.select("part", "nth", "n", "node", F.struct("tree", "level").alias("own")))
    root = roots(high).select("part", "level", F.array().cast(f"array<{STEP}>").alias("path"), F.struct(F.col("digest").alias("root")).alias("known"))
    tops = written(
        pushed(high, root).select(F.col("own.tree").alias("part"), F.col("own.level").alias("level"), "path", F.struct(F.col("known.root").alias("root"), F.col("node").alias("subroot")).alias("known")),
        "merkle-tops",
    )
    return pushed(low, tops)


def proof_text(path: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, start, lambda at, x: digest(x["left"], at, x["right"]))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: each row's leaf, roots, proof digest, and the root folded from its leaf, tampered with where 5 divides crc32(doc_id)."""
    docs = docs.select(*[F.col(c) for c in COLUMNS])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf(*[F.col(c) for c in COLUMNS[:-1]], F.translate("text", UPPER, LOWER))
    rows = manifest(docs.select("doc_id", "source", leaf(*[F.col(c) for c in COLUMNS]).alias("node"), F.when(tampered, changed).alias("changed")))
    fold = folded(F.coalesce("own.changed", "node"), F.col("path"))
    return rows.select(
        "own.doc_id",
        F.col("node").alias("leaf"),
        "known.subroot",
        "known.root",
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
