"""SQLite as a Spark data source: a table in one database file, or in all those of a folder, read in ranges of rowids.

Filters on numbers, texts, dates and flags reach SQLite's own WHERE; only the schema's columns are asked for. Spark keeps
what SQLite can't decide alike (decimals, which are kept as text, and NaN). Writing gives a file for each task: under a
name of its own job first, moved when the job commits, so a task that is tried again, or fails, leaves nothing behind.

The folder has to be one that the driver and all executors see under the same path, such as that of spark.checkpoint.dir.
An empty folder is a table without rows if the schema is given; tables without rowids and views are read in one piece."""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FETCH = 10_000  # rows at a time
ROWID = "_rowid_"  # the name of the three that a column is least likely to have
COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: SQLite's storage classes of Spark's types, and the types that a declared SQLite column gives; fixed values.
STORED = {"byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "date": "TEXT", "timestamp": "TEXT", "timestamp_ntz": "TEXT", "binary": "BLOB", "decimal": "TEXT"}
DECLARED = {"INT": T.LongType(), "CHAR": T.StringType(), "CLOB": T.StringType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "BOOL": T.LongType(), "DATE": T.StringType()}


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"SQLite files need a mounted folder, not {path}")
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect("file:" + path.replace("?", "%3f").replace("#", "%23") + "?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    """The database files: the path itself, or all of the folder but hidden ones."""
    at = _local(path)
    if os.path.isfile(at):
        return [at]
    if not os.path.isdir(at):
        raise FileNotFoundError(at)
    return sorted(f"{at}/{f}" for f in os.listdir(at) if not f.startswith(("_", ".")) and not f.endswith(("-wal", "-shm", "-journal")))


def _stored(value, kind: str):
    """A value as SQLite holds it."""
    if value is None:
        return None
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return value.isoformat() if kind == "date" else value.replace(tzinfo=None).isoformat(" ", "microseconds")
    if kind == "decimal":
        return str(value)
    if kind in ("float", "double") and value != value:
        return "NaN"  # SQLite makes NaN null; as a text it stays, and is greater than any number, as in Spark
    return int(value) if kind == "boolean" else value


def _loaded(values: list, field: T.StructField) -> pa.Array:
    kind = field.dataType.typeName()
    if kind == "decimal":
        scale = Decimal(1).scaleb(-field.dataType.scale)
        return pa.array([None if v is None else Decimal(str(v)).quantize(scale) for v in values], pa.decimal128(field.dataType.precision, field.dataType.scale))
    if kind == "date":
        return pa.array([None if v is None else date.fromisoformat(v) for v in values], pa.date32())
    if kind in ("timestamp", "timestamp_ntz"):
        return pa.array([None if v is None else datetime.fromisoformat(v) for v in values], pa.timestamp("us", "UTC" if kind == "timestamp" else None))
    if kind in ("float", "double"):
        return pa.array([None if v is None else float(v) for v in values], pa.float32() if kind == "float" else pa.float64())
    if kind == "boolean":
        return pa.array([None if v is None else bool(v) for v in values], pa.bool_())
    if kind == "string":
        return pa.array([v if v is None or isinstance(v, str) else str(v) for v in values], pa.string())
    return pa.array(values, {"byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind])


@dataclass
class Piece(InputPartition):
    file: str
    low: int | None  # rowids from low on, up to but not high; all if None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, schema: T.StructType) -> None:
        self.path, self.table, self.rows, self.schema = path, table, rows, schema
        self.where: list[tuple[str, list]] = []  # conditions and what their marks stand for

    def _condition(self, f: Filter) -> tuple[str, list] | None:
        """What SQLite decides as Spark does, or None."""
        if isinstance(f, Not):
            below = self._condition(f.child)
            return below and (f"NOT ({below[0]})", below[1])
        if len(f.attribute) != 1 or f.attribute[0] not in self.schema.names:
            return None
        kind, name = self.schema[f.attribute[0]].dataType.typeName(), _quoted(f.attribute[0])
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        if kind in ("decimal", "binary"):
            return None
        if isinstance(f, (StringStartsWith, StringEndsWith, StringContains)):
            if "\0" in f.value:
                return None
            n = len(f.value)
            return {StringStartsWith: (f"substr({name}, 1, {n}) = ?", [f.value]), StringEndsWith: (f"length({name}) >= {n} AND substr({name}, length({name}) - {n} + 1) = ?", [f.value]), StringContains: (f"instr({name}, ?) > 0", [f.value])}[type(f)]
        values = list(f.value) if isinstance(f, In) else [f.value]
        if any(isinstance(v, float) and v != v for v in values):
            return None
        marks = [_stored(v, kind) for v in values]
        if isinstance(f, In):
            return f"{name} IN ({', '.join('?' * len(marks))})", marks
        return (f"{name} {COMPARED[type(f)]} ?", marks) if type(f) in COMPARED else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = self._condition(f)
            if found:
                self.where.append(found)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        out = []
        for file in _files(self.path):
            with closing(_opened(file)) as db:
                is_table = db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND name = ? COLLATE NOCASE", [self.table]).fetchone()[0]
                try:  # one question each: SQLite answers either from the end of its tree
                    low, high = (db.execute(f"SELECT {end}({ROWID}) FROM {_quoted(self.table)}").fetchone()[0] for end in ("min", "max"))
                except sqlite3.OperationalError:
                    is_table = False  # it has no rowids
                if not is_table:
                    out.append(Piece(file, None, None))
                    continue
            if low is not None:
                out += [Piece(file, a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]
        return out or [Piece("", None, None)]

    def statement(self, piece: Piece) -> tuple[str, list]:
        where, marks = [w for w, _ in self.where], [m for _, ms in self.where for m in ms]
        if piece.low is not None:
            where, marks = [f"{ROWID} >= ?", f"{ROWID} < ?", *where], [piece.low, piece.high, *marks]
        names = ", ".join(map(_quoted, self.schema.names)) or "1"
        return f"SELECT {names} FROM {_quoted(self.table)}" + (" WHERE " + " AND ".join(f"({w})" for w in where) if where else ""), marks

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        with closing(_opened(piece.file)) as db:
            rows = db.execute(*self.statement(piece))
            while some := rows.fetchmany(FETCH):
                yield pa.RecordBatch.from_arrays([_loaded(list(c), f) for c, f in zip(zip(*some), self.schema)], self.schema.names)


@dataclass
class Made(WriterCommitMessage):
    file: str | None


class SqliteWriter(DataSourceArrowWriter):
    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.table, self.schema, self.overwrite = _local(path), table, schema, overwrite
        self.job = f"{self.path}/_{uuid.uuid4().hex}"
        os.makedirs(self.job, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Made:
        file, kinds = f"part-{uuid.uuid4().hex}.db", [f.dataType.typeName() for f in self.schema]
        columns = ", ".join(f"{_quoted(f.name)} {STORED[k]}" for f, k in zip(self.schema, kinds))
        any_row = False
        with closing(sqlite3.connect(f"{self.job}/{file}", isolation_level=None)) as db:
            db.execute("PRAGMA journal_mode = OFF")  # nobody reads the file before it is whole
            db.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            db.execute("BEGIN")
            for b in batches:
                any_row |= b.num_rows > 0
                values = [[_stored(v, k) for v in b.column(i).to_pylist()] for i, k in enumerate(kinds)]
                db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(kinds))})", zip(*values))
            db.execute("COMMIT")
        return Made(file if any_row else None)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for f in os.listdir(self.path):
                if f.startswith("part-"):
                    os.remove(f"{self.path}/{f}")
        for m in messages:
            if m and m.file:
                os.rename(f"{self.job}/{m.file}", f"{self.path}/{m.file}")
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class SqliteSource(DataSource):
    """format("sqlite") with options path, table, and rows: rowids of a partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        """By the declared types of the first file's table."""
        with closing(_opened(_files(self.options["path"])[0])) as db:
            found = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(name, next((t for part, t in DECLARED.items() if part in kind.upper()), T.StringType())) for _, name, kind, *_ in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("rows", 1_000_000)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema, overwrite)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.conf.set(PUSHDOWN, "true")  # filters reach a source only while it is on


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | T.StructType | None = None, rows: int = 1_000_000) -> DataFrame:
    """A table of a database file or of all those of a folder, so many rowids a partition; only the schema's columns are read."""
    _registered(spark)
    reader = spark.read.format("sqlite").option("table", table).option("rows", rows)
    return (reader.schema(schema) if schema else reader).load(path)


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """A database file for each task, in a shared folder; mode append or overwrite."""
    _registered(df.sparkSession)
    df.write.format("sqlite").option("table", table).mode(mode).save(path)
