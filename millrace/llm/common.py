"""Shared helpers of the training-data operators: shared storage, let-bindings, Arrow slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from millrace.sources.shared import cleared, dropped, shared_dir, tables, written  # noqa: F401

#: The word separators of every contract here: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


def _hashable(t: DataType) -> bool:
    if isinstance(t, (MapType, VariantType)):
        return False
    if isinstance(t, ArrayType):
        return _hashable(t.elementType)
    return all(_hashable(f.dataType) for f in t.fields) if isinstance(t, StructType) else True


def content_hash(schema: StructType, seed: int, under: str = "") -> Column:
    """A hash of all of a row's columns that can be hashed; under names the struct that holds them, if one does."""
    return F.xxhash64(F.lit(seed), *[F.col(under)[f.name] if under else F.col(f"`{f.name}`") for f in schema.fields if _hashable(f.dataType)])


def carried(df: DataFrame) -> Column:
    """All columns in one struct _doc, so none clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once and use it many times in body (a lambda variable is never evaluated again)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, an empty array where there are none (null included)."""
    return let(
        F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAPS)),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow array, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most that many bytes of the column together, or one row that is longer."""
    for batch in batches:
        data, offs = binary(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    trim()


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers stay for later tasks, and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def int_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
