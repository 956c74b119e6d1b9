"""Text, identity, quantity and order metrics; all but the sequence ratios as native columns over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import fixed, let, text
from assayer.functions.quantity import equivalent

TIERS = list(fixed.TIER_WEIGHTS)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null over zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def score_set(tp: Column, candidates: Column, references: Column) -> Column:
    """True and false positives, false negatives, precision, recall and F1; 0 over zero."""

    def made(tp: Column) -> Column:
        p, r = F.coalesce(ratio(tp, candidates), F.lit(0.0)), F.coalesce(ratio(tp, references), F.lit(0.0))
        return F.struct(
            tp.alias("true_positives"),
            (candidates - tp).alias("false_positives"),
            (references - tp).alias("false_negatives"),
            p.alias("precision"),
            r.alias("recall"),
            f1(p, r).alias("f1"),
        )

    return let(tp, made)


def text_metrics(candidate: Column, reference: Column) -> Column:
    """strict_equal, normalized_equal, character, token and subsequence likeness, bigram precision, recall and F1."""
    a, b = text.normalized(candidate), text.normalized(reference)
    x, y = text.tokens(candidate), text.tokens(reference)
    grams = lambda t: F.greatest(F.size(t) - 1, F.lit(0))
    shared = text.bigram_overlap(x, y)
    p, r = (F.coalesce(ratio(shared, grams(t)), F.lit(0.0)) for t in (x, y))
    return F.struct(
        (candidate == reference).alias("strict_equal"),
        (a == b).alias("normalized_equal"),
        text.sequence_ratio(a, b).alias("character_similarity"),
        text.token_ratio(text.folded(candidate), text.folded(reference)).alias("token_similarity"),
        text.lcs_ratio(x, y).alias("lcs_ratio"),
        p.alias("bigram_precision"),
        r.alias("bigram_recall"),
        f1(p, r).alias("bigram_f1"),
    )


def _taken(matches: Column, references: Column) -> Column:
    """References with the method of their match, null where they have none."""

    def of(r: Column) -> Column:
        hit = F.filter(matches, lambda m: (m["reference_position"] == r["position"]) & m["candidate_index"].isNotNull())
        return F.struct(r.alias("r"), F.try_element_at(hit, F.lit(1))["method"].alias("method"))

    return F.transform(references, of)


def _count(taken: Column, when) -> Column:
    return F.size(F.filter(taken, when))


def identity_metrics(candidates: Column, references: Column, matches: Column) -> Column:
    """Strict and lenient scores over ordinary references, and recall by kind and tier.

    Candidates matched to sub-recipe references count neither way. Fuzzy matches are lenient only.
    """
    lenient = lambda t: t["method"].isin(*fixed.LENIENT)
    ordinary = lambda t: ~t["r"]["subrecipe_reference"]

    def recall(taken: Column, kind) -> Column:
        return ratio(_count(taken, lambda t: kind(t) & lenient(t)), _count(taken, kind))

    def weight(taken: Column, when) -> Column:
        table = F.create_map(*(F.lit(x) for kv in fixed.TIER_WEIGHTS.items() for x in kv))
        return F.aggregate(
            F.filter(taken, lambda t: ordinary(t) & when(t)), F.lit(0), lambda n, t: n + F.coalesce(table[t["r"]["tier"]], F.lit(0))
        )

    def made(taken: Column) -> Column:
        aside = _count(taken, lambda t: ~ordinary(t) & t["method"].isNotNull())
        said, known = F.size(candidates) - aside, _count(taken, ordinary)
        strict = score_set(_count(taken, lambda t: ordinary(t) & t["method"].isin(*fixed.STRICT)), said, known)
        of_tier = lambda tier: lambda t: ordinary(t) & (t["r"]["tier"] == tier)
        tiers = F.create_map(*(x for tier in TIERS for x in (F.lit(tier), recall(taken, of_tier(tier)))))
        return let(
            strict,
            lambda strict: F.struct(
                strict.alias("strict"),
                score_set(_count(taken, lambda t: ordinary(t) & lenient(t)), said, known).alias("lenient"),
                recall(taken, lambda t: ordinary(t) & ~t["r"]["optional"]).alias("required_recall"),
                recall(taken, lambda t: ordinary(t) & t["r"]["optional"]).alias("optional_recall"),
                recall(taken, lambda t: ~ordinary(t)).alias("subrecipe_recall"),
                tiers.alias("tier_recall"),
                ratio(weight(taken, lenient), weight(taken, lambda t: F.lit(True))).alias("weighted_recall"),
                strict["false_positives"].alias("hallucinated_count"),
                F.coalesce(ratio(strict["false_positives"], said), F.lit(0.0)).alias("hallucinated_rate"),
            ),
        )

    return let(_taken(matches, references), made)


def quantity_status(said: Column, said_fold: Column, known: Column, known_fold: Column) -> Column:
    """exact, equivalent, missing, extra or wrong, of a matched pair's parsed quantities and folded texts."""
    return (
        F.when(said.isNull() & known.isNull(), "exact")
        .when(said.isNull(), "missing")
        .when(known.isNull(), "extra")
        .when(said_fold == known_fold, "exact")
        .when(equivalent(said, known), "equivalent")
        .otherwise("wrong")
    )


def _accepted(matches: Column) -> Column:
    """Lenient matches in candidate order."""
    return F.filter(matches, lambda m: m["method"].isin(*fixed.LENIENT))


def quantity_metrics(candidates: Column, references: Column, matches: Column) -> Column:
    """Status of each matched position, counts and rates over them; equivalent counts take in exact ones."""

    def status(m: Column) -> Column:
        c = F.filter(candidates, lambda c: c["index"] == m["candidate_index"])[0]
        r = F.filter(references, lambda r: r["position"] == m["reference_position"])[0]
        one = let(c, lambda c: let(r, lambda r: quantity_status(c["quantity"], c["quantity_fold"], r["quantity"], r["quantity_fold"])))
        return F.struct(m["reference_position"].alias("position"), one.alias("status"))

    def made(found: Column) -> Column:
        n = F.size(found)
        count = lambda *names: _count(found, lambda s: s["status"].isin(*names))
        counts = {
            "exact": count("exact"),
            "equivalent": count("exact", "equivalent"),
            "missing": count("missing"),
            "wrong": count("wrong"),
            "extra": count("extra"),
        }
        return F.struct(
            n.alias("matched_count"),
            *(c.alias(f"{k}_count") for k, c in counts.items()),
            *(ratio(c, n).alias(f"{k}_rate") for k, c in counts.items()),
            F.map_from_entries(found).alias("statuses"),
        )

    return let(F.transform(_accepted(matches), status), made)


def _pairs(a: Column, keep, good) -> tuple[Column, Column]:
    """How many of the pairs i < j that ``keep`` holds for are ``good``, and how many there are."""

    def count(when) -> Column:
        return F.aggregate(
            F.transform(
                a, lambda x, i: F.size(F.filter(F.slice(a, i + F.lit(2), F.size(a)), lambda y: when(x, y)))
            ),
            F.lit(0),
            lambda n, k: n + k,
        )

    return count(lambda x, y: keep(x, y) & good(x, y)), count(keep)


def order_metrics(candidates: Column, references: Column, matches: Column) -> Column:
    """exact_sequence_match, pairwise and section order accuracy, mean absolute displacement."""

    def made(accepted: Column) -> Column:
        places = F.transform(accepted, lambda m: m["reference_position"])
        listed = F.transform(references, lambda r: r["position"])
        n = F.size(accepted)
        sections = F.array_distinct(F.array_compact(F.transform(references, lambda r: r["section"])))
        matched = F.filter(
            F.transform(
                places, lambda at: F.array_position(sections, F.filter(references, lambda r: r["position"] == at)[0]["section"])
            ),
            lambda k: k > 0,
        )
        moved = F.aggregate(
            accepted, F.lit(0), lambda s, m: s + F.abs(m["candidate_index"] + 1 - m["reference_position"])
        )
        kept = let(places, lambda a: F.struct(*_pairs(a, lambda x, y: F.lit(True), lambda x, y: x < y)))
        across = let(matched, lambda a: F.struct(*_pairs(a, lambda x, y: x != y, lambda x, y: x < y)))
        part = lambda s: let(s, lambda s: ratio(s["col1"], s["col2"]))
        exact = (n == F.size(candidates)) & (n == F.size(references)) & (places == listed)
        return F.struct(
            exact.alias("exact_sequence_match"),
            part(kept).alias("pairwise_accuracy"),
            part(across).alias("section_order_accuracy"),
            ratio(moved, n).alias("mean_absolute_displacement"),
        )

    return let(_accepted(matches), made)
