"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.sources.shared import CLEANUP, shared_root

_areas: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch():
    """Tables staged within are deleted at the end, but for those that are to outlive it.

    For tables that nothing lazy still reads then.
    """
    _areas.append([])
    try:
        yield
    finally:
        for spark, path in _areas.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, *, outlive: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Readers then survive the loss of any executor, and nothing upstream is computed twice.
    """
    path = f"{shared_root(df.sparkSession)}/assayer/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    if areas := _areas[: -1 if outlive else None]:
        areas[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **named: Column) -> DataFrame:
    """The rows as one column ``_row`` beside the named ones, so that no column of theirs clashes with another."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return docs.select(whole, *(c.alias(name) for name, c in named.items()))


def small(table: DataFrame, most: int = 1 << 18) -> DataFrame:
    """A written table of a few narrow columns, to be broadcast if it has ``most`` rows or fewer, else as it is."""
    return F.broadcast(table) if table.count() <= most else table


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, share: int = 1024) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, without a task that gets all rows of a hot key.

    ``table`` has a row for each key, with its number of rows in column ``n``. Keys with one in ``share`` of all
    ``total`` rows or more are at most ``share``; they are broadcast, the others joined by shuffle. Write the table
    before: it is read twice. Nulls must not be keys.
    """
    hot = F.broadcast(table.filter(F.col(n) * share >= F.lit(total)))
    cold = table.filter(F.col(n) * share < F.lit(total))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _doc, _text): _doc numbers documents in the order of their ids, and equal rows alike.

    An integral id that names one text only is its own number. Otherwise ids and texts' hashes are sorted over the
    cluster and numbered by partition and place.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    whole = isinstance(rows.schema["_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    least = -(1 << 63)
    if whole:
        hashes = rows.groupBy("_id").agg(F.min(F.xxhash64("_text")).alias("a"), F.max(F.xxhash64("_text")).alias("b"))
        if hashes.filter(f"a <> b OR _id = {least}L").isEmpty():
            return rows.select("_id", F.coalesce(F.col("_id").cast("long"), F.lit(least)).alias("_doc"), "_text")
    names = rows.select(F.struct("_id", F.xxhash64("_text").alias("_hash")).alias("_name")).distinct()
    order = [F.col("_name._id").asc_nulls_first(), F.col("_name._hash")]
    numbers = staged(
        names.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_doc", F.monotonically_increasing_id()), "numbers"
    )
    named = rows.withColumn("_name", F.struct("_id", F.xxhash64("_text").alias("_hash")))
    return staged(named.join(numbers, "_name").select("_id", "_doc", "_text"), "numbered")
