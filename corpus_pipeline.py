"""The corpus pipeline: quality rules, near-duplicate join, repeated substrings, source mix, packing.

run(spark, sf_dir) applies STAGES to documents; each stage's result is written as Parquet in the shared folder and read
again as the next one's docs. All stages but the last return the columns of documents. SQL can't express the prefix-free
parsing of the third stage, so ORACLE_SQL is None and tests/llm compare each stage with a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from millrace.llm.common import cleared, tables, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of similar ones stays."""
    return jaccard_join.one_of_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that repeat are cut out of the texts."""
    return suffix_dedup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the places of all pieces in the sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = tables()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        cleared(spark, before, docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
