"""Session defaults: UTC, ANSI, adaptive plans, partitions sized to the machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "millrace", cores: int = 8, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its scan has few partitions, as a small file of one row group; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < cores and df.rdd.getNumPartitions() < 4 * cores else df
