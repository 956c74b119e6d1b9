"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import (
    doc_sketch,
    exact_dedup,
    language_id,
    lm_score,
    mixing,
    packing,
    sharding,
    simhash,
    token_counts,
    window_dedup,
)
from assayer.llm.staging import shared_root


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language; the text model learns from ``documents``."""
    model = language_id.train(_read(spark, sf_dir, "documents"))
    pages = language_id.page_evidence(_read(spark, sf_dir, "pages"))
    found = language_id.identify(pages, model, markup=True)
    return found.withColumnRenamed("_id", "page_id").drop("_text_hash")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model scores."""
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors, rate and copies under the default targets."""
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("_hash")


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    return window_dedup.remove_repeats(_read(spark, sf_dir, "documents"), window=100).drop("kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, tokens across lines going to the line of their first byte."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), rule="first")


def op6_doc_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against that of its edited text and of the next document."""
    return doc_sketch.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes by a stored slot map, and their shards under its next version, of 25."""
    path = f"{shared_root(spark)}/assayer/slot-map-{uuid.uuid4().hex}"
    return sharding.shard_by_stored_map(_read(spark, sf_dir, "documents"), path, n_shards=24, grow_to=25).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
        "next_shard",
        "next_version",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of up to 2048 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), limit=2048)


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its place in a sequence, under limits on tokens, turns and the assistant's tokens."""
    return packing.pack_conversations(_read(spark, sf_dir, "conversations"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component that links of 3 bits or fewer make."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, most=3)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its group of equal texts."""
    return exact_dedup.assign(_read(spark, sf_dir, "documents"), keep="largest")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_window_dedup": op4_window_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_doc_sketch": op6_doc_sketch,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "instruction_packing": instruction_packing,
}

ORACLES = {
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
