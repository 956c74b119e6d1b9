"""Grading of responses: text metrics, classification, matching, metrics, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.operators import metrics
from assayer.operators.matching import AliasTable, match, reference_lists
from assayer.operators.responses import classify

EXACT = "exact_or_near_exact_reproduction"
DISAGREE = "strict and lenient ingredient scores disagree"


def _as_candidates(references: Column, like: Column) -> Column:
    """The references as an answer that lists them."""

    def one(r: Column, i: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            i.cast("int").alias("index"),
            r["ingredient_text"].alias("raw"),
            r["quantity"].alias("quantity"),
            F.when(r["quantity"].isNotNull(), r["quantity_fold"]).alias("quantity_fold"),
            r["ingredient_text"].alias("phrase"),
            r["key"].alias("normalized_key"),
            r["identity_key"].alias("identity_key"),
            none.alias("modifier"),
            none.alias("ambiguous_reason"),
            r["text_qualifier"].alias("qualifier"),
        )

    return F.transform(references, one)


def grade(
    responses: DataFrame,
    recipes: DataFrame,
    references: DataFrame,
    *,
    id_col: str = "attempt_id",
    recipe_col: str = "recipe_id",
    alias_table: AliasTable | None = None,
    fuzzy_threshold: float = fixed.FUZZY_THRESHOLD,
    ambiguity_threshold: float = fixed.AMBIGUITY_THRESHOLD,
    on_incomplete: str = "fail",
) -> DataFrame:
    """A graded row for each response.

    responses: ``id_col``, ``recipe_col``, response_text. recipes: ``recipe_col``, reference_text_exact and,
    if there is one, reference_complete. references: ``recipe_col`` and the reference columns. An incomplete
    recipe gets no score of the whole list: with on_incomplete "fail" its responses fail the query when it runs,
    with "drop" they are left out. Adds text, response_class, scored_text, candidates, references, matches,
    identity, quantity, order, reviews and config.
    """
    if on_incomplete not in ("fail", "drop"):
        raise ValueError("on_incomplete must be fail or drop")
    if "reference_complete" in recipes.columns:
        complete = F.coalesce("reference_complete", F.lit(False))
        if on_incomplete == "drop":
            recipes = recipes.filter(complete)
        else:
            stop = F.raise_error(F.concat(F.lit("full-list grading of incomplete reference "), F.col(recipe_col).cast("string")))
            recipes = recipes.withColumn(
                "reference_text_exact", F.when(complete, F.col("reference_text_exact")).otherwise(stop.cast("string"))
            )
    lists = reference_lists(references, recipe_col)
    known = recipes.select(recipe_col, "reference_text_exact").join(lists, recipe_col, "left")
    none = F.filter("references", lambda _: F.lit(False))
    known = known.withColumn("references", F.coalesce("references", none))
    df = classify(responses, id_col).join(known, recipe_col)
    answer, known = F.col("response_text"), F.col("reference_text_exact")
    same = F.col("_same")
    df = df.withColumn("_same", (answer == known) | (text.normalized(answer) == text.normalized(known)))
    df = df.withColumns(
        {
            "candidates": F.when(same, _as_candidates(F.col("references"), F.col("candidates"))).otherwise(F.col("candidates")),
            "scored_text": F.when(same, F.col("response_text")).otherwise(F.col("scored_text")),
        }
    )
    df = match(df, alias_table=alias_table, fuzzy_threshold=fuzzy_threshold, ambiguity_threshold=ambiguity_threshold)
    three = F.col("candidates"), F.col("references"), F.col("matches")
    df = df.withColumns(
        {"identity": metrics.identity_metrics(*three), "quantity": metrics.quantity_metrics(*three), "order": metrics.order_metrics(*three)}
    )
    amounts = (F.col("quantity.matched_count") == 0) | (F.col("quantity.exact_count") == F.col("quantity.matched_count"))
    near = (F.col("identity.strict.f1") == 1.0) & F.col("order.exact_sequence_match") & amounts & (F.size("reviews") == 0)
    disagree = F.array(
        F.struct(
            F.lit(DISAGREE).alias("reason"),
            F.lit(None).cast("string").alias("candidate_evidence"),
            F.array().cast("array<string>").alias("reference_evidence"),
        )
    )
    # Nothing above reads the text metrics: a query that doesn't select them doesn't work them out.
    return df.withColumns(
        {
            "text": metrics.text_metrics(answer, known),
            "response_class": F.when(same | near, EXACT).otherwise(F.col("response_class")),
            "reviews": F.when(
                F.col("identity.strict.f1") != F.col("identity.lenient.f1"), F.concat("reviews", disagree)
            ).otherwise(F.col("reviews")),
            "config": F.struct(
                F.lit(fixed.PROFILE).alias("normalization_profile"),
                F.lit(alias_table.version if alias_table else None).cast("string").alias("alias_version"),
                F.lit(fuzzy_threshold).alias("fuzzy_threshold"),
                F.lit(ambiguity_threshold).alias("ambiguity_threshold"),
            ),
        }
    ).drop("_same")
