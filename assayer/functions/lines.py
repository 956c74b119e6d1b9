"""Ingredient lines as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.quantity import FLAGS, UNIT_WORDS, has_quantity, split_quantity
from assayer.functions.text import SPACE, folded, key_of_folded, strip, words

MARKER = FLAGS + fixed.LIST_MARKER
MEASURE = (
    rf"{FLAGS}^\s*\(\s*(?:about\s+)?{fixed.NUMBER}(?:\s*(?:-|–|—|to)\s*{fixed.NUMBER})?\s+"
    rf"(?:{UNIT_WORDS}|{fixed.SIZES})\s*\)\s*"
)
SIZED = rf"{FLAGS}^({fixed.SIZES})\s+(.+)$"


def has_marker(c: Column) -> Column:
    return c.rlike(MARKER)


def without_marker(c: Column) -> Column:
    return F.regexp_replace(c, MARKER, "")


def heading_kind(c: Column) -> Column:
    """ingredients, stop, or null."""
    name = F.lower(strip(F.regexp_extract(c, FLAGS + fixed.HEADING, 1)))
    return F.when(name.isin(*fixed.INGREDIENT_HEADINGS), "ingredients").when(name.isin(*fixed.STOP_HEADINGS), "stop")


def is_section_heading(c: Column) -> Column:
    """Markdown headings, and lines that end in a colon without marker or quantity."""
    c = strip(c)
    return c.rlike(FLAGS + fixed.MARKDOWN_HEADING) | (c.endswith(":") & ~has_marker(c) & ~has_quantity(c))


def parse_lines(df: DataFrame, line: str, prefix: str = "") -> DataFrame:
    """The rows with the parts of the line in column ``line``.

    Adds quantity, phrase, normalized_key, identity_key, modifier, ambiguous_reason, qualifier (a size, or null)
    and raw, each after ``prefix``; all are null where the line is a heading or has no ingredient. Staged over
    several projections, so that no pattern is matched twice.
    """
    p = prefix
    t = lambda name: F.col(f"_{p}{name}")
    raw = F.regexp_replace(F.col(line), rf"{SPACE}+\z", "")
    df = df.withColumn(f"_{p}raw", raw).withColumn(f"_{p}content", strip(without_marker(t("raw"))))
    df = df.withColumn(f"_{p}split", split_quantity(t("content")))
    df = df.withColumns({f"_{p}quantity": t("split")["quantity"], f"_{p}rest": F.regexp_replace(t("split")["rest"], MEASURE, "")})
    comma = F.locate(",", t("rest"))
    before = F.when(comma > 0, F.substring(t("rest"), F.lit(1), comma - 1)).otherwise(t("rest"))
    after = F.when(comma > 0, strip(F.substring(t("rest"), comma + 1, F.length(t("rest")))))
    phrase = F.trim(F.regexp_replace(before, FLAGS + fixed.TRAILING, ""), F.lit(" .;:"))
    df = df.withColumns({f"_{p}phrase": phrase, f"_{p}after": after})
    df = df.withColumns({f"_{p}fold": folded(t("phrase")), f"_{p}sized": F.regexp_extract(t("phrase"), SIZED, 2)})
    df = df.withColumns({f"_{p}key": key_of_folded(t("fold")), f"_{p}sized": key_of_folded(folded(t("sized")))})
    counted = F.arrays_overlap(words(t("sized")), F.array(*map(F.lit, fixed.SIZED_HEADS)))
    counted = F.coalesce(counted, F.lit(False))
    sound = (t("content") != "") & heading_kind(t("content")).isNull() & (t("phrase") != "")
    made = {
        "raw": t("raw"),
        "quantity": t("quantity"),
        "phrase": t("phrase"),
        "normalized_key": t("key"),
        "identity_key": F.when(counted, t("sized")).otherwise(t("key")),
        "modifier": F.when(t("after") != "", t("after")),
        "ambiguous_reason": F.when(t("phrase").rlike(FLAGS + fixed.NEGATION), "negated ingredient mention").when(
            t("phrase").rlike(FLAGS + r"\bor\b"), "ingredient alternative"
        ),
        "qualifier": F.when(counted, F.lower(F.regexp_extract(t("phrase"), SIZED, 1))),
    }
    df = df.withColumn(f"_{p}sound", sound)
    df = df.withColumns({f"{p}{name}": F.when(t("sound"), c) for name, c in made.items()})
    return df.drop(*(f"_{p}{x}" for x in ("raw", "content", "split", "quantity", "rest", "phrase", "after", "fold", "sized", "key", "sound")))
