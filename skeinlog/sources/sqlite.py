"""A data source for tables of SQLite files: one partition per file, read only, columns that lack read as null."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SqliteSource(DataSource):
    """Options: ``path`` (a glob), ``table`` and ``columns`` (comma lists; of the tables those that are there are read, columns as
    text, or with ``binary`` as hexadecimal digits of their bytes). Adds ``path`` and ``row``.
    """

    @classmethod
    def name(cls) -> str:
        return "skeinlog_sqlite"

    def schema(self) -> StructType:
        names = [c.strip() for c in self.options["columns"].split(",")]
        return StructType([StructField("path", StringType()), StructField("row", LongType()), *[StructField(n, StringType()) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.tables, self.columns = options["path"], [t.strip() for t in options["table"].split(",")], schema.names[2:]
        self.shape = 'hex("{}")' if str(options.get("binary", "")).lower() == "true" else 'CAST("{}" AS TEXT)'

    def partitions(self) -> list[InputPartition]:
        plain = self.path.removeprefix("file://")
        return [_File(p) for p in sorted(glob.glob(plain))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path or not os.path.exists(partition.path):
            return
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            row = 0
            for table in self.tables:
                have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
                if not have & set(self.columns):
                    continue
                picked = ", ".join(self.shape.format(c) if c in have else "NULL" for c in self.columns)
                for values in db.execute(f'SELECT {picked} FROM "{table}"'):
                    yield (partition.path, row, *(v or None for v in values))
                    row += 1


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SqliteSource)
