"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame functions only.

Every row falls into a run by a hash of its id; runs have about ``RUN_ROWS`` rows, so their number grows with the
table. A run is sorted by digest, and equal neighbours become one entry: digest, id to keep, rows. In each round
``fan_in`` neighbouring runs meet slice by slice of the digest space, are merged in digest order by Spark's sort, and
equal neighbours become one again (a sort-based aggregate: it looks at neighbours only and holds one entry). After log(runs) rounds one run, in slices over the cluster, has an entry for each distinct text. A run has
one entry of a text however often it holds it, so a text that a third of all rows share costs a task at most ``fan_in``
entries in a round. The answer goes down the same way: root to first-level entries, those to rows, by (digest, run).

Identity is verified at every level: entries merge only where SHA-256, a second independent 64-bit hash and
the byte length all agree.

Defined results: a null text equals the empty one. Rows with equal id and text are one document: they keep or
fall together in ``assign`` and leave one row in ``drop_copies``. A null id is kept only where no copy has an
id. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.staging import boxed, scratch, staged

KEY = ("_digest", "_check", "_bytes")
#: The most rows that a first-level run has on average.
RUN_ROWS = 1 << 18


def _identity(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
        F.xxhash64(text).alias("_check"),
        F.octet_length(text).alias("_bytes"),
    ]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One narrow row for each document: its id, identity and run."""
    return docs.select(
        F.col(id_col).alias("_id"),
        *_identity(F.col(text_col)),
        F.pmod(F.xxhash64(id_col), F.lit(runs)).cast("int").alias("_run"),
    )


def sorted_runs(rows: DataFrame, keep: str) -> DataFrame:
    """Level 0: every run in digest order, an entry for each distinct text of it.

    Each task sorts its own part of the runs and puts equal neighbours together before anything is exchanged. The
    struct to keep has no fixed-width buffer, which makes Spark aggregate by sort, here and in ``merged``.
    """
    best = F.max if keep == "largest" else F.min
    return rows.groupBy("_run", *KEY).agg(best(_ranked(keep)).alias("_keep"), F.count("*").alias("_size"))


def merged(entries: DataFrame, keep: str, slices: int) -> DataFrame:
    """Runs of equal number merged in digest order, slice by slice, equal neighbours as one entry."""
    best = F.max if keep == "largest" else F.min
    by = ["_run", "_slice", *KEY]
    return (
        entries.withColumn("_slice", F.pmod(F.col("_check"), F.lit(slices)))
        .repartition("_run", "_slice")
        .sortWithinPartitions(*by)
        .groupBy(*by)
        .agg(best("_keep").alias("_keep"), F.sum("_size").alias("_size"))
        .drop("_slice")
    )


def _ranked(keep: str):
    """An id as a struct that orders a null last in preference."""
    known = F.col("_id").isNotNull()
    return F.struct((known if keep == "largest" else ~known).alias("known"), F.col("_id").alias("id"))


def merge_runs(entries: DataFrame, runs: int, fan_in: int, keep: str) -> DataFrame:
    """Binomial rounds over first-level entries; returns the root: an entry for each distinct text."""
    slices = max(64, runs)
    while runs > 1:
        runs = -(-runs // fan_in)
        entries = merged(entries.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")), keep, slices)
    return entries.drop("_run")


def _resolved(
    docs: DataFrame, id_col: str, text_col: str, keep: str, runs: int | None, fan_in: int
) -> DataFrame:
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    if runs is None:
        runs = fan_in * fan_in
        rows_in = docs.count()
        while runs * RUN_ROWS < rows_in:
            runs *= fan_in
    rows = staged(digest_runs(docs, id_col, text_col, runs), "digests")
    first = staged(sorted_runs(rows, keep), "runs")
    root = merge_runs(first, runs, fan_in, keep)
    down = first.select(*KEY, "_run").join(root, list(KEY))
    return rows.join(down, [*KEY, "_run"]).withColumn("_keep", F.col("_keep.id"))


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "largest",
    runs: int | None = None,
    fan_in: int = 8,
) -> DataFrame:
    """A row for each input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    return _resolved(docs, id_col, text_col, keep, runs, fan_in).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "largest",
    runs: int | None = None,
    fan_in: int = 8,
) -> DataFrame:
    """The input's rows and columns, one row for each distinct text."""
    with scratch():
        stays = (
            _resolved(docs, id_col, text_col, keep, runs, fan_in)
            .filter(F.col("_id").eqNullSafe(F.col("_keep")))
            .select(F.struct("_id", "_digest").alias("_stays"))
            .distinct()
        )
        stays = staged(stays, "stays", outlive=True)
    tagged = boxed(docs, _name=F.struct(F.col(id_col).alias("_id"), _identity(F.col(text_col))[0]))
    # The window is over the join's own key, so rows are shuffled once.
    once = Window.partitionBy("_name").orderBy(F.lit(0))
    left = tagged.join(stays, F.col("_name") == F.col("_stays"))
    return left.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").select("_row.*")
