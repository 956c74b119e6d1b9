"""The wide recipe file to normalized tables, with everything that is wrong with it as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import checks
from assayer.operators.checks import complexity_score, or_null, strict_boolean

RECORD = (
    "array<struct<position: int, section: string, text_exact: string, quantity_text_exact: string, ingredient_text: string,"
    " ingredient_key: string, tier: string, optional: boolean, subrecipe_reference: boolean>>"
)
RECORD_KEYS = [
    "ingredient_key", "ingredient_text", "optional", "position", "quantity_text_exact", "section", "subrecipe_reference",
    "text_exact", "tier",
]
TIERS = ["primary", "secondary", "tertiary"]


def read_wide_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The file as strings: quoted line breaks and a byte-order mark are allowed, missing columns are not."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def json_list(c: Column, kind: str = "array<string>") -> Column:
    """A JSON array's elements; null where the text is anything else (see ``not_lists``)."""
    return F.when(F.json_array_length(c).isNotNull(), F.from_json(c, kind))


def not_lists(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, field) of cells that hold no JSON array."""
    cells = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in columns))).alias("x"))
    return cells.filter(F.json_array_length("x.v").isNull()).select(key, "x.field")


def ingredients(df: DataFrame, records: str = "ingredient_records_json") -> DataFrame:
    """A row for each ingredient record; empty sections and quantities as null."""
    rows = df.select("recipe_id", F.explode(json_list(F.col(records), RECORD)).alias("r")).select("recipe_id", "r.*")
    return rows.withColumns({"section": or_null(F.col("section")), "quantity_text_exact": or_null(F.col("quantity_text_exact"))})


def listed(df: DataFrame, column: str, name: str) -> DataFrame:
    """(recipe_id, position, name) of a JSON list's elements, from 1."""
    each = df.select("recipe_id", F.posexplode(json_list(F.col(column))).alias("p", name))
    return each.select("recipe_id", (F.col("p") + 1).alias("position"), name)


def ratings(df: DataFrame, scores: list[str], rubric: str) -> DataFrame:
    """A row for each score column."""
    wide = df.select("recipe_id", *(F.col(c).cast("int").alias(c) for c in scores))
    return wide.unpivot("recipe_id", scores, "dimension", "score").withColumn("rubric_version", F.lit(rubric))


def rating_links(sources: DataFrame, rated: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Every source of a recipe with each of its ratings that isn't derived."""
    human = dimensions.filter("value_kind <> 'derived'").select("dimension")
    return sources.join(rated.join(F.broadcast(human), "dimension"), "recipe_id")


def _issue(df: DataFrame, kind: str) -> DataFrame:
    return df.select("recipe_id", F.lit(kind).alias("issue")).distinct()


def record_issues(df: DataFrame, records: str = "ingredient_records_json") -> DataFrame:
    """(recipe_id, issue) of ingredient records of the wrong shape, order, tier or digest, or against declared counts.

    Places only: no ingredient text is in the result.
    """
    raw = df.select("recipe_id", F.explode(F.from_json(F.col(records), "array<string>")).alias("one"))
    keys = F.array_sort(F.json_object_keys("one"))
    shape = raw.filter(~F.coalesce(keys == F.array(*map(F.lit, RECORD_KEYS)), F.lit(False)))
    rows = ingredients(df, records)
    found = [
        _issue(shape, "record keys"),
        _issue(checks.not_contiguous(rows, ["recipe_id"], "position"), "positions not contiguous"),
        _issue(checks.outside(rows, "tier", TIERS), "unknown tier"),
    ]
    if "ingredient_count" in df.columns:
        declared = df.select("recipe_id", F.col("ingredient_count").cast("int").alias("declared"))
        found.append(_issue(checks.count_mismatches(declared, rows, "recipe_id", "recipe_id", "declared"), "ingredient count"))
    if {"reference_text_exact", "reference_sha256"} <= set(df.columns):
        found.append(_issue(checks.wrong_digests(df, "reference_text_exact", "reference_sha256"), "text digest"))
    if "complexity_score" in df.columns and "ingredient_count" in df.columns:
        derived = complexity_score(F.col("ingredient_count").cast("int"))
        found.append(_issue(df.filter(F.col("complexity_score").cast("int") != derived), "complexity score"))
    if "is_complete" in df.columns and "status" in df.columns:
        complete = strict_boolean(F.col("is_complete"))
        found.append(_issue(df.filter(~complete.eqNullSafe(F.col("status") == "complete")), "status"))
    return reduce(DataFrame.union, found)


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, text) of fenced text blocks under second-level headings of Markdown files."""
    pattern = r"(?m)^##[ \t]+([^\n]+)\n(?:(?!##|```)[^\n]*\n)*?```text\n([\s\S]*?)^```"
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    titles, texts = (F.regexp_extract_all("value", F.lit(pattern), F.lit(i)) for i in (1, 2))
    each = pages.select("file", F.explode(F.arrays_zip(titles.alias("title"), texts.alias("text"))).alias("x"))
    return each.select("file", F.trim("x.title").alias("title"), F.rtrim("x.text", F.lit("\n")).alias("text"))
