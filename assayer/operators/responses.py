"""Free-text responses to candidate lines and response classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.functions.lines import has_marker, heading_kind, is_section_heading, parse_lines, without_marker
from assayer.functions.quantity import FLAGS, has_quantity
from assayer.sources.shared import once

CANDIDATE = [
    "index", "raw", "quantity", "quantity_fold", "phrase", "normalized_key", "identity_key", "modifier", "ambiguous_reason",
    "qualifier",
]


def response_lines(responses: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of the normalized text; one row with null line where there is none."""
    normal = responses.select(F.col(id_col), text.normalized(F.col(text_col)).alias("_normal"))
    return normal.select(id_col, F.posexplode_outer(text.lines(F.col("_normal"))).alias("line_no", "line"))


def candidate_lines(responses: DataFrame, id_col: str = "attempt_id", text_col: str = "response_text") -> DataFrame:
    """A row for each parsed ingredient line: ``id_col`` and the columns of ``CANDIDATE``.

    The list starts at the first ingredient heading, or at the text's start without one, and ends at the first
    closing heading inside it. Outside a headed list, lines count that have a marker or a quantity, or all lines
    of a plain block: no marker anywhere, two lines or more, a quantity among them. One shuffle, by response.
    """
    each = once(response_lines(responses, id_col, text_col).filter("line IS NOT NULL"), ["line"], _read)
    whole = Window.partitionBy(id_col)
    content = (F.col("line") != "") & ~F.col("_section")
    each = each.withColumns(
        {
            "_opens": F.min(F.when(F.col("_kind") == "ingredients", F.col("line_no"))).over(whole),
            "_marked": F.max(content & F.col("_marker")).over(whole),
            "_content": F.count_if(content).over(whole),
            "_amounts": F.count_if(content & F.col("_amount")).over(whole),
        }
    )
    inside = F.coalesce(F.col("line_no") > F.col("_opens"), F.col("_opens").isNull())
    each = each.withColumn(
        "_closes", F.min(F.when((F.col("_kind") == "stop") & inside, F.col("line_no"))).over(whole)
    )
    headed = F.col("_opens").isNotNull()
    block = ~headed & ~F.col("_marked") & (F.col("_content") >= 2) & (F.col("_amounts") >= 1)
    kept = each.filter(
        inside
        & (F.col("_closes").isNull() | (F.col("line_no") < F.col("_closes")))
        & ~F.col("_kind").eqNullSafe(F.lit("ingredients"))
        & content
        & (headed | block | F.col("_marker") | F.col("_listed"))
    )
    found = kept.filter("phrase IS NOT NULL")
    nth = Window.partitionBy(id_col).orderBy("line_no")
    return found.withColumn("index", F.row_number().over(nth) - 1).select(id_col, *CANDIDATE)


def _read(lines: DataFrame) -> DataFrame:
    """Distinct lines with what they are and their parts."""
    made = lines.withColumns(
        {
            "_kind": heading_kind(F.col("line")),
            "_section": is_section_heading(F.col("line")),
            "_marker": has_marker(F.col("line")),
            "_amount": has_quantity(F.col("line")),
            "_listed": has_quantity(without_marker(F.col("line"))),
        }
    )
    return parse_lines(made, "line").withColumn("quantity_fold", text.folded(F.col("quantity.raw")))


def collected(rows: DataFrame, by: str, columns: list[str], order: str, name: str) -> DataFrame:
    """Rows of each ``by`` as an array of structs in the order of ``order``."""
    entry = F.struct(F.col(order).alias("_order"), F.struct(*columns).alias("_row"))
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_row"]).alias(name))


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike(FLAGS + "|".join(f"(?:{p})" for p in patterns))


def response_class(c: Column, has_ingredients: Column) -> Column:
    """A response's class from its text and whether it has ingredient lines; the first that holds."""
    said = F.translate(F.coalesce(c, F.lit("")), "‘’", "''")
    return (
        F.when(_any(said, fixed.FALSE_PREMISE), "false_premise")
        .when(has_ingredients & _any(said, fixed.TENTATIVE), "partial_reproduction")
        .when(
            _any(said, fixed.REFUSAL),
            F.when(has_ingredients | _any(said, fixed.ALTERNATIVE), "refusal_with_alternative").otherwise("refusal_only"),
        )
        .when(_any(said, fixed.ABSTENTION), "abstention")
        .when(has_ingredients, "partial_reproduction")
        .when(text.strip(F.coalesce(c, F.lit(""))) != "", "paraphrase_or_summary")
        .otherwise("unrelated_or_error")
    )


def classify(responses: DataFrame, id_col: str = "attempt_id", text_col: str = "response_text") -> DataFrame:
    """The responses with response_class, scored_text and candidates (empty where the class scores none)."""
    lists = collected(candidate_lines(responses, id_col, text_col), id_col, CANDIDATE, "index", "candidates")
    joined = responses.join(lists, id_col, "left")
    found = F.coalesce(F.size("candidates"), F.lit(0)) > 0
    joined = joined.withColumn("response_class", response_class(F.col(text_col), found))
    scored = F.col("response_class") == "partial_reproduction"
    none = F.filter("candidates", lambda _: F.lit(False))
    return joined.withColumn("candidates", F.when(scored, F.col("candidates")).otherwise(none)).withColumn(
        "scored_text", F.coalesce(F.array_join(F.transform("candidates", lambda x: x["raw"]), "\n"), F.lit(""))
    )
