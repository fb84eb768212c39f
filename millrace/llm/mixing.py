"""Operator 9: mixing sources to target weights over a multivariate-hypergeometric splitting tree, DataFrame functions only.

Documents are dealt into blocks of about BLOCK documents by a hash of their content within their source. A source's target
is reached by whole passes over its blocks plus one partial pass: blocks in permuted order while they fit, then part of the
first block that doesn't: its longest documents that still fit, permuted among equals, and one more if that comes nearer. The block
draws of all sources form exact quotas; a binary tree splits them among the output shards, each node drawing the left
child's share of every source from the multivariate hypergeometric law (by inversion, driven by hashes). A source's draws
in permuted order then go to its shards' quotas one after another, so the shards hold disjoint runs of permuted blocks; what a
document is taken is the number of its block's draws that the shards hold. Inside a shard the rows are shuffled by a hash.

Every choice follows from the rows' content, so the result is the same for any order, partitioning or rerun of the input;
rows equal in every column are interchangeable. Shards follow the size of the mix (SHARD words each).

Null texts have size 0; a null source is a source of its own, after all others; repeated rows and repeated or null
doc_ids are rows of their own; extra columns are carried through; an empty table gives no rows. A source whose size
is 0 has target 0 and none of its documents is taken; very long texts are documents like others, and one that is longer than
what is left of a target is only taken if that comes nearer to it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import carried, content_hash, let, word_count, written

BLOCK = 512
CYCLE = (1.0, 2.0, 3.0)
MOST = 3
SHARD = 1 << 23  # words of an output shard
STRIPES = 10  # bits: running sums over a source's blocks are made in so many parts
SEED = 9


def _unit(*keys: Column) -> Column:
    """A number in [0, 1) that the keys fix."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares by weight, stopped at most times the size.

    The excess is reshared by weight until no source is above: with sources in the order of size by weight, the stopped
    ones are a prefix, and the level of the rest follows from running sums. One row a source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    i = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in cycle]), i + 1))
    full = F.col("source_size") * F.lit(float(most))
    by = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    w = w.withColumns(
        {
            "_full": full,
            "_nth": F.row_number().over(by),
            "_level": (F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        }
    )
    # The first that isn't stopped has the level of all behind it.
    w = w.withColumn("_lambda", F.min(F.when(F.col("_full") / F.col("weight") > F.col("_level"), F.struct("_nth", "_level"))).over(every)["_level"])
    return w.select("source", "source_size", "weight", F.least("_full", F.coalesce(F.col("_lambda") * F.col("weight"), F.col("_full"))).alias("target"))


def hypergeometric(k: Column, slots: Column, total: Column, u: Column) -> Column:
    """How many of the k marked ones of total are among slots drawn without replacement, at the quantile u in [0, 1).

    By inversion: the law's weights come from their ratios, over twelve standard deviations and more around the mean."""
    k, m, n = (x.cast("double") for x in (k, slots, total))
    mean = m * k / n
    spread = F.ceil(12 * F.sqrt(F.greatest(mean * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))) + 8
    low = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean) - spread).cast("long")
    high = F.least(m, k, F.floor(mean) + spread).cast("long")

    def drawn(b: Column) -> Column:
        def ratio(i: Column) -> Column:
            return (b["k"] - i) * (b["m"] - i) / ((i + 1) * (b["n"] - b["k"] - b["m"] + i + 1))

        steps = F.sequence(b["low"], b["high"])
        weight = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
            lambda a, i: F.struct((a["p"] * ratio(i)).alias("p"), (a["sum"] + a["p"]).alias("sum")),
        )["sum"]
        return let(
            weight * b["u"],
            lambda upto: F.aggregate(
                steps,
                F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), b["low"].alias("at")),
                lambda a, i: F.struct((a["p"] * ratio(i)).alias("p"), (a["sum"] + a["p"]).alias("sum"), F.when(a["sum"] <= upto, i).otherwise(a["at"]).alias("at")),
            )["at"],
        )

    bound = F.struct(k.alias("k"), m.alias("m"), n.alias("n"), low.alias("low"), high.alias("high"), u.alias("u"))
    return F.when((total > 0) & (k > 0) & (m > 0), let(bound, drawn)).otherwise(F.lit(0).cast("long"))


def split_tree(root: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(shard, quotas array<bigint>) for 2**levels shards from one row with quotas: the block draws of each source.

    A node is a row. It splits its draws exactly in half, source after source."""
    nodes = root.select(F.lit(0).cast("long").alias("shard"), F.col("quotas").cast("array<bigint>").alias("quotas"))
    state = "struct<slots:bigint,total:bigint,left:array<bigint>>"

    def added(level: int):
        def add(a: Column, x: Column) -> Column:
            share = hypergeometric(x, a["slots"], a["total"], _unit(F.lit(seed), F.lit(level), F.col("shard"), F.size(a["left"])))
            return let(share, lambda k: F.struct((a["slots"] - k).alias("slots"), (a["total"] - x).alias("total"), F.concat(a["left"], F.array(k)).alias("left")).cast(state))

        return add

    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        first = let(total, lambda t: F.struct(F.ceil(t / 2).cast("long").alias("slots"), t.alias("total"), F.array().cast("array<bigint>").alias("left")).cast(state))
        split = nodes.select("shard", "quotas", F.aggregate("quotas", first, added(level))["left"].alias("left"))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        nodes = split.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas")))).alias("x")).select("x.*")
        if level == 6 and levels > 8:
            nodes = nodes.repartition(1 << 7, "shard")  # the subtrees grow apart
    return nodes


def _sources(sizes: DataFrame) -> DataFrame:
    """Written, a row a source: source, source_size, target, _rank, _blocks, _passes whole passes and _rest words of a partial one."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    goal = targets(by_source.select("source", "source_size")).select(F.col("source").alias("_s"), "target")
    size, target = F.col("source_size"), F.col("target")
    out = by_source.join(goal, F.col("source").eqNullSafe(F.col("_s"))).withColumns(
        {
            "_blocks": F.greatest(F.ceil(F.col("_n") / BLOCK), F.lit(1)),
            "_passes": F.when(size > 0, F.floor(target / size + 1e-12)).otherwise(F.lit(0)).cast("int"),
            "_rank": (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"),
        }
    )
    rest = F.when(F.col("_passes") < MOST, F.greatest(target - F.col("_passes") * size, F.lit(0.0))).otherwise(F.lit(0.0))
    return written(out.withColumn("_rest", rest).drop("_s", "_n"), "mix-sources")


def _blocks(placed: DataFrame, seed: int) -> DataFrame:
    """Written, a row a block: its place _nth in its source's permuted order, whether the partial pass takes it whole or cuts it,
    the words _left for it, and its number of draws.

    Running sums go over stripes of the order first, then inside each, so no source is summed up in one task."""
    blocks = placed.groupBy("_rank", "_block").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"), F.first("_passes").alias("_passes"))
    blocks = blocks.withColumn("_at", F.xxhash64(F.lit(seed + 2), "_rank", "_block")).withColumn("_stripe", F.shiftrightunsigned("_at", 64 - STRIPES))
    stripes = blocks.groupBy("_rank", "_stripe").agg(F.sum("_words").alias("_sum"), F.count("*").alias("_count"))
    before = W.partitionBy("_rank").orderBy("_stripe").rowsBetween(W.unboundedPreceding, -1)
    stripes = stripes.select(
        F.col("_rank").alias("_r"), F.col("_stripe").alias("_s"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sums"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_counts"),
        F.sum("_count").over(W.partitionBy("_rank")).alias("_all"),
    )
    order = W.partitionBy("_rank", "_stripe").orderBy("_at", "_block")
    inside = F.coalesce(F.sum("_words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_in": inside, "_nr": F.row_number().over(order) - 1})
    blocks = blocks.join(stripes, (F.col("_rank") == F.col("_r")) & (F.col("_stripe") == F.col("_s")))
    left = F.col("_rest") - F.col("_sums") - F.col("_in")
    whole = (F.col("_rest") > 0) & (left >= F.col("_words"))
    cut = (F.col("_rest") > 0) & (left < F.col("_words")) & (left > 0)
    return written(
        blocks.select(
            "_rank", "_block", (F.col("_counts") + F.col("_nr")).alias("_nth"), "_all", "_passes", cut.alias("_cut"), left.alias("_left"), (F.col("_passes") + (whole | cut).cast("int")).alias("_draws")
        ),
        "mix-blocks",
    )


def _shards(blocks: DataFrame, levels: int, seed: int) -> DataFrame:
    """(_rank, _block, shards): the shard of each of a block's draws, in the order of the passes.

    Draw number i of a source goes to the shard whose quota covers i. Numbers and quotas meet in bins of the source's mean
    quota, each quota in the few bins it reaches over."""
    counts = blocks.groupBy("_rank").agg(F.sum("_draws").alias("_n"))
    root = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_n"))), lambda x: x["_n"]).alias("quotas"))  # a number a source
    width = F.greatest(F.ceil(F.col("_n") / (1 << levels)), F.lit(1))
    quotas = split_tree(root, levels, seed).select(F.col("shard").alias("_shard"), F.posexplode("quotas").alias("_rank", "_quota")).where("_quota > 0")
    quotas = quotas.withColumn("_to", F.sum("_quota").over(W.partitionBy("_rank").orderBy("_shard")))
    quotas = quotas.join(counts.withColumn("_width", width), "_rank").withColumn("_from", F.col("_to") - F.col("_quota"))
    bins = F.sequence(F.floor(F.col("_from") / F.col("_width")), F.floor((F.col("_to") - 1) / F.col("_width")))
    quotas = quotas.select("_rank", "_shard", "_from", "_to", F.explode(bins).alias("_bin"))

    draws = blocks.where("_draws > 0").join(counts.withColumn("_width", width), "_rank")
    draws = draws.select("_rank", "_block", "_nth", "_all", "_width", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)).alias("_pass"))
    draws = draws.withColumn("_i", F.col("_pass") * F.col("_all") + F.col("_nth")).withColumn("_bin", F.floor(F.col("_i") / F.col("_width")))
    met = draws.join(quotas, ["_rank", "_bin"]).where((F.col("_from") <= F.col("_i")) & (F.col("_i") < F.col("_to")))
    listed = met.groupBy("_rank", "_block").agg(F.array_sort(F.collect_list(F.struct("_pass", "_shard"))).alias("_l"))  # MOST at most
    return listed.select("_rank", "_block", F.transform("_l", lambda x: x["_shard"]).alias("shards"))


def plan_of(sizes: DataFrame, seed: int = SEED, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(plan, levels) of a written table (_row, _key, source, size, ...): the table with source_size, target, copies and
    shards array<bigint> (the shard of each copy, of 2**levels). Everything here is rows of numbers; no text moves."""
    sources = _sources(sizes)
    words = sources.agg(F.sum("target")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max(words / shard, 1))))
    s = sources.withColumnRenamed("source", "_s")
    placed = sizes.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.col("_blocks")))
    blocks = _blocks(placed, seed)
    shards = _shards(blocks, levels, seed)

    # Of a cut block (one a source at most) the longest rows that still fit, then one more if that comes nearer: decided on
    # the number of rows of each size, so equal rows are never gathered.
    cut = placed.join(blocks.where("_cut").select("_rank", "_block", "_left"), ["_rank", "_block"]).where("size > 0")
    sizes_of = cut.groupBy("_rank", "size").agg(F.count("*").alias("n"), F.first("_left").cast("double").alias("_left")).groupBy("_rank")
    sizes_of = sizes_of.agg(F.first("_left").alias("_left"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("_l"))
    state = "struct<left:double,some:array<struct<size:bigint,n:bigint,take:bigint>>>"

    def filled(a: Column, x: Column) -> Column:
        take = F.least(x["n"], F.floor(a["left"] / x["size"]))
        return F.struct((a["left"] - take * x["size"]).alias("left"), F.concat(a["some"], F.array(F.struct(x["size"].alias("size"), x["n"].alias("n"), take.alias("take")))).alias("some")).cast(state)

    some = F.aggregate("_l", F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<size:bigint,n:bigint,take:bigint>>").alias("some")).cast(state), filled)
    sizes_of = sizes_of.select("_rank", some.alias("_s")).select("_rank", "_s", F.array_min(F.transform(F.filter("_s.some", lambda x: x["take"] < x["n"]), lambda x: F.struct(F.abs(x["size"] - F.col("_s.left")).alias("off"), x["size"].alias("size")))).alias("_near"))
    sizes_of = sizes_of.select("_rank", "_s.left", "_near", F.explode("_s.some").alias("x"))
    nearer = F.coalesce((F.col("_near.size") == F.col("x.size")) & (F.col("_near.off") < F.col("left")), F.lit(False))
    sizes_of = sizes_of.select("_rank", F.col("x.size").alias("size"), (F.col("x.take") + nearer.cast("int")).alias("_take"))
    nth = F.row_number().over(W.partitionBy("_rank", "size").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_row"))
    fit = cut.withColumn("_of", nth).join(sizes_of, ["_rank", "size"]).where("_of <= _take").select("_row", F.lit(True).alias("_in"))

    where = blocks.select("_rank", "_block", "_cut").join(shards, ["_rank", "_block"])
    out = placed.join(where, ["_rank", "_block"], "left").join(fit, "_row", "left")
    mine = F.when(F.col("size") > 0, F.coalesce("shards", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>"))
    # The last draw of a cut block is that of the partial pass.
    out = out.withColumn("shards", F.when(F.coalesce("_cut", F.lit(False)) & F.col("_in").isNull() & (F.size(mine) > 0), F.slice(mine, F.lit(1), F.size(mine) - 1)).otherwise(mine))
    return out.select(*sizes.columns, "source_size", "target", F.size("shards").alias("copies"), "shards"), levels


def mixture_plan(docs: DataFrame, seed: int = SEED, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(plan, levels); plan has for each row of docs (doc_id, text, source, more) _row, _key, doc_id, source, size,
    source_size, target, copies and shards."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), content_hash(docs.schema, seed).alias("_key"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    return plan_of(written(rows, "mix-sizes"), seed, shard)


def mixture_digest(docs: DataFrame) -> DataFrame:
    """The query's columns for each row of docs."""
    plan, _ = mixture_plan(docs.select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """The mix: each document as often as it is taken, dealt into shards, a partition each, and shuffled inside."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("_row"), content_hash(docs.schema, seed).alias("_key"), word_count(F.col("text")).alias("size"), carried(docs)), "mix-docs")
    plan, levels = plan_of(keyed.select("_row", "_key", F.col("_doc.source").alias("source"), "size"), seed, shard)
    # The text moves once, by its row key, then its copies to their shards.
    out = keyed.join(plan.where("copies > 0").select("_row", "shards"), "_row").select("_doc", "_key", F.posexplode("shards").alias("_copy", "_shard"))
    out = out.repartitionById(1 << levels, F.col("_shard").cast("int")).sortWithinPartitions(F.xxhash64(F.lit(seed + 3), "_key", "_copy"), "_copy")
    return out.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
