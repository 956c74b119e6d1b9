"""Reference audit: every exact line must parse, match its own reference strictly, and keep its quantity.

Results name places and kinds of issue, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.functions.quantity import round_trips
from assayer.operators.matching import OF_CANDIDATE, OF_REFERENCE, match, named
from assayer.sources.shared import once


def audited(records: DataFrame) -> DataFrame:
    """A row for each record: recipe_id, position, parsed, identity_ok, has_quantity, quantity_ok.

    records: recipe_id, position, text_exact and the reference columns.
    """
    texts = ["text_exact", "ingredient_key", "ingredient_text", "quantity_text_exact"]
    each = once(records, texts, lambda df: named(df, {"c_": "text_exact"}))
    # A record's own line and its own reference are one row, so their quantities meet here.
    parsed = F.col("c_phrase").isNotNull()
    said = text.strip(F.coalesce("quantity_text_exact", F.lit(""))) != ""
    kept = said & parsed & round_trips(F.col("c_quantity"), F.col("quantity"))
    each = each.withColumns({"parsed": parsed, "has_quantity": said, "quantity_ok": kept})
    c = F.struct("position", *(F.col(f"c_{x}").alias(x) for x in OF_CANDIDATE if x != "index"))
    r = F.struct("position", *(x for x in OF_REFERENCE if x != "position"), "parsed", "has_quantity", "quantity_ok")
    lists = each.groupBy("recipe_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("parsed"), c))).alias("candidates"), F.array_sort(F.collect_list(r)).alias("references")
    )
    lists = match(lists.withColumn("candidates", F.transform("candidates", lambda c, i: c.withField("index", i))))

    def own(m: Column) -> Column:
        """Whether a candidate has its own reference for certain."""
        at = F.try_element_at("candidates", m["candidate_index"] + 1)["position"]
        return m["method"].isin(*fixed.STRICT) & (m["reference_position"] == at)

    right = F.transform(F.filter("matches", own), lambda m: m["reference_position"])
    rows = lists.select("recipe_id", right.alias("_right"), F.explode("references").alias("r"))
    return rows.select(
        "recipe_id", "r.position", "r.parsed", F.array_contains("_right", F.col("r.position")).alias("identity_ok"), "r.has_quantity", "r.quantity_ok"
    )


def issues(rows: DataFrame) -> DataFrame:
    """(recipe_id, position, kind) of audited rows: unparseable_line, identity_mismatch, quantity_mismatch."""
    kinds = F.when(~F.col("parsed"), F.array(F.lit("unparseable_line"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.col("identity_ok"), "identity_mismatch"), F.when(F.col("has_quantity") & ~F.col("quantity_ok"), "quantity_mismatch")
            )
        )
    )
    return rows.select("recipe_id", "position", F.explode(kinds).alias("kind"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: recipes, ingredients, identity and quantity matches, recipes without an issue."""
    sound = F.col("parsed") & F.col("identity_ok") & (~F.col("has_quantity") | F.col("quantity_ok"))
    recipes = rows.groupBy("recipe_id").agg(
        F.count("*").alias("n"), F.count_if("identity_ok").alias("i"), F.count_if("has_quantity").alias("h"), F.count_if("quantity_ok").alias("q"),
        F.bool_and(sound).alias("perfect"),
    )
    return recipes.agg(
        F.count("*").alias("recipes"), F.sum("n").alias("ingredients"), F.sum("i").alias("identity_matches"), F.sum("h").alias("populated_quantities"),
        F.sum("q").alias("quantity_matches"), F.count_if("perfect").alias("perfect_recipes"),
    )
