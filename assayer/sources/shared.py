"""The folder that driver and executors share, and what depends on texts alone, worked out there once for each text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes the files of an execution's shuffles at its end, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="assayer-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def written(rows: DataFrame, name: str = "texts") -> DataFrame:
    """The rows, written to the shared folder and read back; their size is known then and their plan stays apart."""
    spark, path = rows.sparkSession, f"{shared_root(rows.sparkSession)}/assayer/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def joined(df: DataFrame, texts: list[str], table: DataFrame) -> DataFrame:
    """df with the other columns of a table that has a row for each row of ``texts``, nulls among them."""
    key = [f"_of{i}" for i in range(len(texts))]
    table = table.withColumnsRenamed(dict(zip(texts, key, strict=True)))
    same = [F.col(t).eqNullSafe(F.col(k)) for t, k in zip(texts, key, strict=True)]
    return df.join(table, same).drop(*key)


def once(df: DataFrame, texts: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made`` of df, where it adds columns that depend on the columns ``texts`` alone: one run for each distinct row of them.

    Texts repeat, and a line's grammar costs far more than a join. Every text is kept, however many there are.
    """
    return joined(df, texts, written(made(written(df.select(*texts).distinct()))))


def once_each(df: DataFrame, columns: dict[str, str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made`` of a table of lines (column line), for several columns of df: one run over the distinct lines of all.

    ``columns`` names a column for each prefix of the added names. df is read once for each of them; write it before.
    """
    lines = None
    for c in columns.values():
        of = df.select(F.col(c).alias("line"))
        lines = of if lines is None else lines.union(of)
    table = written(made(lines.distinct()))
    for prefix, c in columns.items():
        df = joined(df, [c], table.withColumnsRenamed({x: c if x == "line" else f"{prefix}{x}" for x in table.columns}))
    return df
