"""SQLite files as a Spark data source, split by rowid ranges; and the sinks to a folder of files and to one file.

The files must lie where every executor can open them. A split opens its own read-only
connection and reads one rowid range, so the scan is parallel. In a folder every task has
written its own file of a table, and ``<table>.json`` names those of the tasks that count, so
no row passes the driver. One file has one writer and is for small graphs.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import uuid
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from geoweft.schema import TABLES

# Table and column names of the file format, in the order of the schemas.
SQL_TABLES = {
    "entity": ("entity", ["id"]),
    "edge": ("edge", ["id", "source_entity", "target_entity", "label"]),
    "position": ("position_component", ["entity_id", "x", "y"]),
    "property": ("property", ["entity_id", "key", "value_type", "value_int", "value_float", "value_text"]),
    "blob": ("blob_store", ["entity_id", "key", "hash", "mime", "size_bytes", "data"]),
}
DDL = {
    "entity": "id INTEGER PRIMARY KEY", "edge": "id INTEGER PRIMARY KEY, source_entity INTEGER NOT NULL, target_entity INTEGER NOT NULL, label INTEGER NOT NULL DEFAULT 0",
    "position": "entity_id INTEGER PRIMARY KEY, x REAL NOT NULL, y REAL NOT NULL",
    "property": "entity_id INTEGER NOT NULL, key TEXT NOT NULL, value_type INTEGER NOT NULL, value_int INTEGER, value_float REAL, value_text TEXT",
    "blob": "entity_id INTEGER NOT NULL, key TEXT NOT NULL, hash INTEGER NOT NULL, mime TEXT DEFAULT '', size_bytes INTEGER NOT NULL, data BLOB",
}
#: Rows of a file of a folder that one task reads; rows that are Python values at once, and those with a blob.
SPLIT_ROWS, ROWS, BLOB_ROWS = 1_000_000, 10_000, 200


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _rows_at_once(table: str) -> int:
    return BLOB_ROWS if table == "blob" else ROWS


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.name, self.splits = options["path"], options["table"], int(options.get("splits", 8))
        self.schema = schema

    def partitions(self):
        if os.path.isdir(self.path):
            with open(f"{self.path}/{self.name}.json") as f:
                files = json.load(f)
            return [_Range(f"{self.path}/{file}", a, min(a + SPLIT_ROWS, rows + 1)) for file, rows in files for a in range(1, rows + 1, SPLIT_ROWS)] or [_Range("", 0, 0)]
        table, _ = SQL_TABLES[self.name]
        with closing(_open(self.path)) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
        if low is None:
            return [_Range(self.path, 0, 0)]
        step = max(1, -(-(high - low + 1) // self.splits))
        return [_Range(self.path, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part):
        if part.low == part.high:
            return
        table, cols = SQL_TABLES[self.name]
        schema = to_arrow_schema(self.schema)
        with closing(_open(part.path)) as c:
            found = c.execute(f"SELECT {', '.join(cols)} FROM {table} WHERE rowid >= ? AND rowid < ?", (part.low, part.high))
            while rows := found.fetchmany(_rows_at_once(self.name)):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """A file for each task, rows in the order they come; ids may repeat and the schema's nulls stay, so columns have only types."""

    def __init__(self, options):
        self.path, self.name = options["path"], options["table"]

    def write(self, iterator):
        table, cols = SQL_TABLES[self.name]
        file, count = f"{self.name}-{uuid.uuid4().hex}.db", 0
        db = None
        try:
            for batch in iterator:
                if db is None:
                    db = sqlite3.connect(f"{self.path}/{file}", isolation_level=None)
                    db.execute("PRAGMA journal_mode = OFF")  # a file that isn't whole is never named
                    db.execute("PRAGMA synchronous = OFF")
                    db.execute("BEGIN")
                    db.execute(f"CREATE TABLE {table} ({re.sub(' PRIMARY KEY| NOT NULL', '', DDL[self.name])})")
                insert = f"INSERT INTO {table} ({', '.join(cols)}) VALUES ({', '.join('?' * len(cols))})"
                for a in range(0, batch.num_rows, _rows_at_once(self.name)):
                    some = batch.slice(a, _rows_at_once(self.name))
                    db.executemany(insert, zip(*[c.to_pylist() for c in some.columns], strict=True))
                count += batch.num_rows
            if db is not None:
                db.execute("COMMIT")
        finally:
            if db is not None:
                db.close()
        return _Written(file, count)

    def commit(self, messages):
        with open(f"{self.path}/{self.name}.json", "w") as f:
            json.dump([(m.file, m.rows) for m in messages if m and m.rows], f)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(f"{self.path}/{m.file}"):
                os.remove(f"{self.path}/{m.file}")


class SqliteGraphSource(DataSource):
    """Options: path (of a file, or a folder of files), table (entity, edge, position, property, blob), splits (of one file)."""

    @classmethod
    def name(cls):
        return "sqlite_graph"

    def schema(self):
        return TABLES[self.options["table"]]

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_table(spark: SparkSession, path: str, table: str, splits: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteGraphSource)
    return spark.read.format("sqlite_graph").option("path", path).option("table", table).option("splits", splits).load()


def _frame(graph, name: str) -> DataFrame:
    df = getattr(graph, {"entity": "entities", "edge": "raw_edges", "position": "positions", "property": "properties", "blob": "blobs"}[name])
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])


def write_files(graph, path: str, tables=tuple(TABLES)) -> None:
    """Export a graph of any size, or some of its tables, to a folder that all hosts see: each task writes a file of its own."""
    graph.spark.dataSource.register(SqliteGraphSource)
    os.makedirs(path)
    for name in tables:
        _frame(graph, name).write.format("sqlite_graph").mode("append").option("path", path).option("table", name).save()


def write_file(graph, path: str, batch: int = 10_000) -> None:
    """Export a small graph to one file. The rows stream through the driver, batch by batch."""
    db = sqlite3.connect(path)
    for name in TABLES:
        table, cols = SQL_TABLES[name]
        db.execute(f"CREATE TABLE {table} ({DDL[name]})")
        insert, rows = f"INSERT INTO {table} ({', '.join(cols)}) VALUES ({', '.join('?' * len(cols))})", []
        for r in _frame(graph, name).toLocalIterator():
            rows.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
            if len(rows) == batch:
                db.executemany(insert, rows)
                rows = []
        db.executemany(insert, rows)
    db.commit()
    db.close()
