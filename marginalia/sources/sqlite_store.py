"""SQLite tables as a Spark data source, read in ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

ROWS_PER_PARTITION = 250_000


class StoreError(RuntimeError):
    """The file is missing, unreadable or not a store."""


def _connect(path: str) -> sqlite3.Connection:
    try:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5.0)
        con.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchone()
        return con
    except sqlite3.Error as exc:
        raise StoreError(f"cannot open {path!r}: {exc}") from exc


def _type_of(declared: str):
    name = declared.upper()
    if "INT" in name:
        return LongType()
    if any(part in name for part in ("REAL", "FLOA", "DOUB", "TIMESTAMP")):
        return DoubleType()
    return BinaryType() if "BLOB" in name else StringType()


def table_columns(path: str, table: str) -> list[tuple[str, str]]:
    con = _connect(path)
    try:
        rows = con.execute("SELECT name, type FROM pragma_table_info(?)", (table,)).fetchall()
    finally:
        con.close()
    return rows


def has_fulltext(path: str) -> bool:
    """Whether any table or view of the store is named like a full-text index."""
    con = _connect(path)
    try:
        return con.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name LIKE '%fts%' LIMIT 1").fetchone() is not None
    finally:
        con.close()


@dataclass
class RowRange(InputPartition):
    """Row ids from ``low`` to ``high``, both included."""

    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> list[RowRange]:
        """Ranges of so many rows each. Their number follows the rows, however far apart their ids lie."""
        con = _connect(self.path)
        try:
            last = con.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0]
            low = con.execute(f'SELECT min(rowid) FROM "{self.table}"').fetchone()[0]
            ranges = []
            while low is not None:
                after = con.execute(
                    f'SELECT rowid FROM "{self.table}" WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?', (low, ROWS_PER_PARTITION)).fetchone()
                ranges.append(RowRange(low, after[0] - 1 if after else last))
                low = after[0] if after else None
        finally:
            con.close()
        return ranges or [RowRange(1, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        casts = [_coerce(f.dataType) for f in self.schema.fields]
        con = _connect(self.path)
        try:
            query = f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?'
            for row in con.execute(query, (partition.low, partition.high)):
                yield tuple(None if v is None else cast(v) for cast, v in zip(casts, row))
        finally:
            con.close()


def _coerce(kind):
    """SQLite values carry their own type; bring them to the declared one."""
    if isinstance(kind, LongType):
        return int
    if isinstance(kind, DoubleType):
        return float
    if isinstance(kind, BinaryType):
        return lambda v: v.encode() if isinstance(v, str) else bytes(v)
    return lambda v: v.decode(errors="replace") if isinstance(v, bytes) else str(v)


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``.

    The file must be reachable under the same path from every worker.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        columns = table_columns(self.options["path"], self.options["table"])
        if not columns:
            raise StoreError(f"no table {self.options['table']!r} in {self.options['path']!r}")
        return StructType([StructField(name, _type_of(kind)) for name, kind in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema)


def read_table(spark: SparkSession, path: str, table: str):
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).load()
