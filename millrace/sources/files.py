"""Readers and writers. Schemas are given, never inferred; everything goes through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.shared import written


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table or one split of a named dataset."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{split}")


def csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV files, globs included, with multi-line quoted fields; only the asked columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one object or a list of objects a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder, by extension."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    return reader.load(path)


def converted(files: DataFrame, convert) -> DataFrame:
    """(path, text, error) of binary files by convert(bytes) -> str, such as a PDF library's; one file's error stops no other."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            text, error = [], []
            for content in pdf["content"]:
                try:
                    text.append(convert(bytes(content)))
                    error.append(None)
                except Exception as e:  # the error is the row's result
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "text": text, "error": error})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of another database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def _indexed(df: DataFrame, order: Column) -> DataFrame:
    """df, sorted, with an unnamed row number from 0 before its columns: ranges of the order are numbered apart and shifted by the sums
    of the rows before, of which there is one for each range."""
    cut = written(df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("__index_range"), F.monotonically_increasing_id().alias("__index_at")), "csv-ranges")
    sums = cut.groupBy("__index_range").agg(F.count("*").alias("__index_n"), F.min("__index_at").alias("__index_first")).withColumn("__index_all", F.col("__index_range") * 0)
    before = F.sum("__index_n").over(W.partitionBy("__index_all").orderBy("__index_range")) - F.col("__index_n")
    shifts = sums.select(F.col("__index_range").alias("__index_r"), (before - F.col("__index_first")).alias("__index_shift"))
    placed = cut.join(F.broadcast(shifts), F.col("__index_range") == F.col("__index_r"))
    return placed.select((F.col("__index_at") + F.col("__index_shift")).alias("Unnamed: 0"), *[F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, index: Column | None = None) -> None:
    """CSV with a header; with index (an order) the first column is an unnamed row number from 0."""
    if index is not None:
        df = _indexed(df, index)
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_batches(df: DataFrame, path: str, rows: int = 100_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def stamped(prefix: str, extension: str, now: Column | None = None) -> Column:
    """A file name with a time: prefix_yyyyMMdd_HHmmss.extension."""
    return F.concat(F.lit(prefix + "_"), F.date_format(now if now is not None else F.current_timestamp(), "yyyyMMdd_HHmmss"), F.lit("." + extension))
