"""Reports over graded cells, and the adapters of answers in rows with pipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.functions.quantity import FLAGS, UNIT_WORDS, has_quantity
from assayer.functions.text import strip
from assayer.operators.metrics import ratio


def pair_counts() -> list[Column]:
    """Of rows of paired candidates (idx) and references (position)."""
    both = F.col("idx").isNotNull() & F.col("position").isNotNull()
    return [F.count("idx").alias("candidates"), F.count("position").alias("references_n"), F.count_if(both).alias("true_positives")]


def micro_scores(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of summed counts; null over zero."""
    counts = ["candidates", "references_n", "true_positives"]
    sums = cells.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts))
    tp, said, known = F.col("true_positives"), F.col("candidates"), F.col("references_n")
    return sums.withColumns(
        {"precision": ratio(tp, said), "recall": ratio(tp, known), "f1": F.try_divide(2.0 * tp, (said + known).cast("double"))}
    )


def recall_columns(hit: Column) -> list[Column]:
    """Recall of required, optional and primary references and by weight, from reference rows."""
    weight = F.create_map(*(F.lit(x) for kv in fixed.TIER_WEIGHTS.items() for x in kv))[F.col("tier")]
    of = lambda kind: ratio(F.count_if(kind & hit), F.count_if(kind))
    return [
        of(~F.col("optional")).alias("required_recall"),
        of(F.col("optional")).alias("optional_recall"),
        of(F.col("tier") == "primary").alias("primary_recall"),
        ratio(F.sum(F.when(hit, weight).otherwise(0)), F.sum(weight)).alias("weighted_recall"),
    ]


def grouped(df: DataFrame, model: str, recipe: str, prompt: str, measures: Sequence[Column]) -> DataFrame:
    """The report's four grouping sets: prompt; model, prompt; recipe, prompt; model, recipe, prompt.

    One pass; label joins the values of the set's columns by a pipe.
    """
    sets = [[F.col(prompt)], [F.col(model), F.col(prompt)], [F.col(recipe), F.col(prompt)], [F.col(model), F.col(recipe), F.col(prompt)]]
    keys = [model, recipe, prompt]
    flags = [F.grouping(k).cast("long") for k in keys]
    named = F.concat_ws(" | ", *(F.when(F.grouping(k) == 0, F.col(k)) for k in keys))
    made = df.groupingSets(sets, *keys).agg(
        named.alias("label"), (flags[0] * 4 + flags[1] * 2 + flags[2]).alias("grouping_set"), *measures
    )
    return made.drop(*keys)


def cell_metrics(graded: DataFrame) -> DataFrame:
    """Counts of each graded response that reports add up, and coverage over all its references."""
    q, s = F.col("quantity"), F.col("identity.strict")
    n = F.size("references")
    return graded.withColumns(
        {
            "true_positives": s["true_positives"],
            "candidates_n": s["true_positives"] + s["false_positives"],
            "references_n": s["true_positives"] + s["false_negatives"],
            "exact_quantities": q["exact_count"],
            "equivalent_quantities": q["equivalent_count"],
            "exact_coverage": ratio(q["exact_count"], n),
            "equivalent_coverage": ratio(q["equivalent_count"], n),
            "reviews_n": F.size("reviews"),
        }
    )


def bigram_counts(df: DataFrame, key: str, column: str, only: DataFrame | None = None) -> DataFrame:
    """(key, gram, n, total) of folded tokens; total counts all bigrams of the key's text.

    With ``only`` (column gram, distinct) other bigrams go before the shuffle, and totals still count them. A key is
    to name one text.
    """
    words = df.select(F.col(key), text.tokens(F.col(column)).alias("_w"))
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    two = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    grams = words.select(key, F.explode(two).alias("gram"), n.cast("long").alias("total"))
    if only is not None:
        grams = grams.join(only, "gram", "left_semi")
    return grams.groupBy(key, "gram", "total").agg(F.count("*").alias("n")).select(key, "gram", "n", "total")


def bigram_matches(a: DataFrame, b: DataFrame, a_key: str, b_key: str, *, least_recall: float) -> DataFrame:
    """Pairs whose shared bigrams, copies counted, reach a share of b's; precision and recall over a and b.

    Pairs meet on bigrams of b only; give ``bigram_counts`` of a those alone.
    """
    left = a.select(a_key, "gram", F.col("n").alias("_na"), F.col("total").alias("_ta"))
    right = b.select(b_key, "gram", F.col("n").alias("_nb"), F.col("total").alias("_tb"))
    shared = left.join(right, "gram").groupBy(a_key, b_key, "_ta", "_tb").agg(F.sum(F.least("_na", "_nb")).alias("shared"))
    return shared.filter(F.col("shared") >= least_recall * F.col("_tb")).select(
        a_key, b_key, "shared", ratio(F.col("shared"), F.col("_ta")).alias("bigram_precision"), ratio(F.col("shared"), F.col("_tb")).alias("bigram_recall")
    )


def containing(texts: DataFrame, parts: DataFrame, text_key: str, part_key: str, text_col: str, part_col: str, words: int = 4) -> DataFrame:
    """(text_key, part_key): texts that contain a part, both composed, folded and with white space collapsed.

    No nested loop: a part meets texts by an equi-join on the first whole words inside it (its own first and last
    word may be cut off in a text), and containment is checked there. Shorter parts meet texts by their one
    longest inner word, or, without an inner word, by comparison with every text, which only such parts need.
    """
    t = texts.select(text_key, text.leakage_form(F.col(text_col)).alias("_t"))
    p = parts.select(part_key, text.leakage_form(F.col(part_col)).alias("_p")).filter("_p <> ''")
    p = p.withColumn("_w", F.split("_p", " "))
    inner = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0)))
    p = p.withColumn("_k", F.least(F.size(inner), F.lit(words))).withColumn("_key", F.array_join(F.slice(inner, F.lit(1), F.greatest("_k", F.lit(1))), " "))
    widths = [r["_k"] for r in p.select("_k").distinct().collect()]  # at most ``words`` + 1 values
    found = None
    for k in widths:
        of = p.filter(F.col("_k") == k)
        if k == 0:
            hit = t.join(F.broadcast(of) if of.count() <= 10_000 else of, F.contains(F.col("_t"), F.col("_p")))
        else:
            w = F.split("_t", " ")
            runs = t.select(text_key, "_t", F.explode(F.array_distinct(_runs(w, k))).alias("_key"))
            # Texts travel to the join only where they have a part's words.
            runs = runs.join(F.broadcast(of.select("_key").distinct()), "_key", "left_semi") if of.count() <= 10_000 else runs
            hit = runs.join(of, "_key").filter(F.contains(F.col("_t"), F.col("_p")))
        hit = hit.select(text_key, part_key)
        found = hit if found is None else found.union(hit)
    if found is None:
        found = t.select(text_key).join(p.select(part_key), F.lit(False))
    return found.distinct()


def _runs(w: Column, k: int) -> Column:
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    joined = F.slice(w, F.lit(1), n)
    for i in range(1, k):
        joined = F.zip_with(joined, F.slice(w, F.lit(i + 1), n), lambda a, b: F.concat_ws(" ", a, b))
    return joined


# Answers in rows of quantity | ingredient.

_START = rf"{FLAGS}(?<!\w)(?:{fixed.NUMBER}(?:\s*(?:-|–|—|to)\s*{fixed.NUMBER})?\s*(?:(?:{UNIT_WORDS})(?=\s|\|))?|unknown)\s*\|"


def without_narration(lines: Column) -> Column:
    """The first line from its quantity on, where words stand before the quantity of its first pipe."""
    first = lines[0]
    at = F.regexp_instr(first, F.lit(_START))
    bare = F.when((at > 1) & (at <= F.locate("|", first)), F.substring(first, at, F.length(first))).otherwise(first)
    return F.when(F.size(lines) > 0, F.concat(F.array(bare), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))).otherwise(lines)


def plain_rows(line: Column) -> Column:
    """A piped line as lines that the ingredient parser reads; other lines stay."""
    spaced = F.regexp_replace(line, r"(?i)\b([0-9]+(?:\.[0-9]+)?)(ml|g|kg|l|oz)\b", "$1 $2")
    cells = F.transform(F.split(spaced, r"\|"), strip)
    quantity, name = cells[0], F.try_element_at(cells, F.lit(2))
    unknown = F.lower(quantity).isin("unknown", "")
    doubled = F.lower(F.coalesce(name, F.lit(""))).startswith(F.lower(quantity)) & (quantity != "")
    joined = F.when(unknown | doubled, name).otherwise(F.concat_ws(" ", quantity, name))
    even = F.filter(F.transform(cells, lambda c, i: F.when(i % 2 == 0, F.concat_ws(" ", c, F.try_element_at(cells, i + 2)))), lambda c: c.isNotNull())
    n = F.size(cells)
    return F.when(n == 1, F.array(spaced)).when(n == 2, F.array(joined)).otherwise(F.filter(even, lambda c: c != ""))


def adapt_rows(c: Column) -> Column:
    """A piped answer as plain ingredient lines."""
    lines = F.filter(F.transform(text.lines(c), strip), lambda x: x != "")
    return F.array_join(F.flatten(F.transform(without_narration(lines), plain_rows)), "\n")


def compliant(c: Column) -> Column:
    """Whether every line is one quantity (or unknown), a pipe and an ingredient."""
    lines = F.filter(F.transform(text.lines(c), strip), lambda x: x != "")

    def row(x: Column) -> Column:
        cells = F.transform(F.split(x, r"\|"), strip)
        return (F.size(cells) == 2) & (F.element_at(cells, -1) != "") & ((F.lower(cells[0]) == "unknown") | has_quantity(cells[0]))

    return (F.size(lines) > 0) & F.forall(lines, row)
