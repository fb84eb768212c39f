"""Tables in the folder that the driver and all executors share: they cut a lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[str] = []  # what written() has made and nobody has dropped
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, as in tests;
    on a cluster that is an error, since executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    The shuffle files of the writing plan go with it: nothing reads them once the table is complete."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None) if spark.conf.isModifiable(CLEANUP) else ""
    if before != "":
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is not None and before != "":
            spark.conf.set(CLEANUP, before)
        elif before is None:
            spark.conf.unset(CLEANUP)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete a table of written() that a later one has replaced."""
    _delete(table.sparkSession, table.shared_path)


def tables() -> int:
    """A mark for cleared(): the number of tables so far."""
    return len(_tables)


def cleared(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the tables that were written since the mark, but not keep."""
    for path in _tables[mark:]:
        if path != keep.shared_path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _tables:
        _tables.remove(path)
