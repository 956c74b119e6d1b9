"""Stores: read-only SQLite scans, staged publishing of tables, JSON lines."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_ro")`` with options path (on every executor), query or table, and a schema.

    With partition_column, lower, upper and partitions, the scan is split by ranges of an integer column.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        raise ValueError("give the scan a schema")

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, [f.name for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path = options["path"]
        self.source = f"({options['query']})" if "query" in options else f'"{options["table"]}"'
        self.columns, self.options = columns, dict(options)

    def partitions(self) -> list[InputPartition]:
        column = self.options.get("partition_column")
        if not column:
            return [InputPartition(None)]
        low, high, n = (int(self.options[k]) for k in ("lower", "upper", "partitions"))
        cuts = [low + (high + 1 - low) * i // n for i in range(n + 1)]
        return [InputPartition((column, a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: InputPartition):
        names = ", ".join(f'"{c}"' for c in self.columns)
        sql, values = f"SELECT {names} FROM {self.source}", ()
        if partition.value:
            column, *values = partition.value
            sql += f' WHERE "{column}" >= ? AND "{column}" < ?'
        store = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from store.execute(sql, tuple(values))
        finally:
            store.close()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, validate: Callable[[Mapping[str, DataFrame]], None]) -> None:
    """Write all tables beside ``path``, check what was written, then move it into place.

    Whatever fails, what stood at ``path`` before is still there.
    """
    place, fs = _files(spark, path)
    fresh, fs = _files(spark, f"{path}.new-{uuid.uuid4().hex}")
    try:
        for name, df in tables.items():
            df.write.parquet(f"{fresh}/{name}")
        validate({name: spark.read.parquet(f"{fresh}/{name}") for name in tables})
    except BaseException:
        fs.delete(fresh, True)
        raise
    old, _ = _files(spark, f"{path}.old-{uuid.uuid4().hex}")
    there = fs.exists(place)
    if there:
        fs.rename(place, old)
    if not fs.rename(fresh, place):
        if there:
            fs.rename(old, place)
        raise OSError(f"could not move new tables to {path}")
    if there:
        fs.delete(old, True)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; a file appears whole or not at all."""
    df.write.mode("append").json(path)
