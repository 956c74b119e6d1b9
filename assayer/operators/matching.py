"""One-to-one matching of candidate ingredients to references.

What a reference can be called is worked out once for each reference, as columns, before it meets any response.
Matching itself is greedy and depends on order, so it runs as one kernel over a response's arrays, a batch of
responses at a time. Where every reference has a single name, ``match_kth_occurrence`` does the same by a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.functions.lines import parse_lines
from assayer.functions.quantity import parse_quantity
from assayer.operators.responses import collected
from assayer.sources.shared import once, once_each

MATCH = "struct<candidate_index: int, reference_position: int, method: string, score: double, candidate_evidence: string, reference_evidence: string, reason: string>"
REVIEW = "struct<reason: string, candidate_evidence: string, reference_evidence: array<string>>"
NAMED = ["quantity", "quantity_fold", "key", "variants", "identity_variants", "identity_key", "text_qualifier", "qualifier"]
REFERENCE = [
    "position", "ingredient_key", "ingredient_text", "quantity_text_exact", "tier", "optional", "subrecipe_reference", "section", *NAMED,
]
NEGATED = "negated ingredient mention"


def _plain(c: Column) -> Column:
    """A name without trailing optional or page marks."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+optional$", ""), r"\s+page\s+[0-9]+$", "")


def prepare_references(references: DataFrame, recipe_col: str = "recipe_id") -> DataFrame:
    """References with their names, quantity and qualifier; a row for each.

    variants: the key, the text before a comma, and both as parsed lines (unless negated), without trailing
    marks, and again without a leading measure. identity_variants: those and the identity keys.
    """
    texts = ["ingredient_key", "ingredient_text", "quantity_text_exact"]
    return once(references, texts, named).select(recipe_col, *REFERENCE)


def named(texts: DataFrame, lines: dict[str, str] | None = None) -> DataFrame:
    """Written rows of ingredient_key, ingredient_text and quantity_text_exact with what ``prepare_references`` adds.

    ``lines`` names further columns to be parsed, with their prefixes; the parts are kept.
    """
    base = F.substring_index("ingredient_text", ",", 1)
    columns = {"k_": "ingredient_key", "t_": "ingredient_text"} | (lines or {})
    df = once_each(texts, columns, lambda lines: parse_lines(lines, "line"))
    kept = [x for x in df.columns if x.startswith(tuple(lines or ())) and x not in texts.columns] if lines else []
    df = df.withColumns(
        {
            "key": text.ingredient_key(F.col("ingredient_key")),
            "_base": text.ingredient_key(base),
            "quantity": parse_quantity(F.col("quantity_text_exact")),
            "quantity_fold": text.folded(F.coalesce("quantity_text_exact", F.lit(""))),
        }
    )
    parsed = [
        F.when(~F.coalesce(F.col(f"{p}ambiguous_reason"), F.lit("")).eqNullSafe(NEGATED), F.col(f"{p}normalized_key"))
        for p in ("k_", "t_")
    ]
    names = F.array_compact(F.array(*map(_plain, [F.col("key"), F.col("_base"), *parsed])))

    def without(measure: str) -> Column:
        found = F.filter(names, lambda v: v.startswith(measure))
        return F.transform(found, lambda v: F.substring(v, F.lit(len(measure) + 1), F.length(v)))

    bare = map(without, fixed.LEADING_MEASURES)
    identity = F.array_compact(F.array(_plain(F.col("k_identity_key")), _plain(F.col("t_identity_key"))))
    filled = lambda c: F.filter(F.array_distinct(c), lambda v: v != "")
    df = df.withColumn("variants", filled(F.concat(names, *bare)))
    df = df.withColumn("identity_variants", filled(F.concat("variants", identity)))
    df = df.withColumns(
        {
            "identity_key": F.col("t_identity_key"),
            "text_qualifier": F.col("t_qualifier"),
            "qualifier": F.coalesce("t_qualifier", "k_qualifier"),
        }
    )
    return df.select(*texts.columns, *NAMED, *kept)


def reference_lists(references: DataFrame, recipe_col: str = "recipe_id") -> DataFrame:
    """(recipe, references): prepared references of each recipe in order of position."""
    return collected(prepare_references(references, recipe_col), recipe_col, REFERENCE, "position", "references")


@dataclass(frozen=True)
class AliasTable:
    """Versioned other names of canonical ingredient keys."""

    version: str
    aliases: Mapping[str, Collection[str]] = field(default_factory=dict)

    def keys(self, spark) -> dict[str, set[str]]:
        """Normalized names of normalized keys, through the engine's own columns."""
        rows = [(k, a) for k, names in self.aliases.items() for a in names]
        found: dict[str, set[str]] = defaultdict(set)
        if rows:
            df = spark.createDataFrame(rows, "k string, a string")
            for r in df.select(text.ingredient_key(F.col("k")).alias("k"), text.ingredient_key(F.col("a")).alias("a")).collect():
                found[r.k].add(r.a)
        return dict(found)


@lru_cache(maxsize=1 << 16)
def similarity(a: str, b: str, least: float = 0.0) -> float:
    """The larger of token F1 and sequence ratio. Below ``least`` any value below it may stand for it."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    tokens = 2 * len(x & y) / (len(x) + len(y))
    if tokens < least:
        ratio = SequenceMatcher(None, a, b, autojunk=False)
        if ratio.real_quick_ratio() < least or ratio.quick_ratio() < least:
            return tokens
        return max(tokens, ratio.ratio())
    return max(tokens, SequenceMatcher(None, a, b, autojunk=False).ratio())


class _Pairing:
    """One response's candidates and references while they are being paired."""

    def __init__(self, candidates: list[dict], references: list[dict]):
        self.candidates, self.references = candidates, references
        self.open_c = {c["index"]: c for c in candidates}
        self.open_r = {r["position"]: r for r in references}
        self.by_name: dict[str, dict[str, list[dict]]] = {}
        self.matches: list[dict] = []
        self.reviews: list[dict] = []

    def review(self, reason: str, candidate: dict, references=()) -> None:
        self.reviews.append(
            {"reason": reason, "candidate_evidence": candidate["raw"], "reference_evidence": [r["ingredient_text"] for r in references]}
        )

    def add(self, c: dict | None, r: dict | None, method: str, score: float = 0.0, reason: str | None = None) -> None:
        self.matches.append(
            {
                "candidate_index": c and c["index"],
                "reference_position": r and r["position"],
                "method": method,
                "score": score,
                "candidate_evidence": c and c["raw"],
                "reference_evidence": r and r["ingredient_text"],
                "reason": reason,
            }
        )

    def pair(self, c: dict, r: dict, method: str, score: float = 1.0) -> None:
        self.add(c, r, method, score)
        del self.open_c[c["index"]], self.open_r[r["position"]]

    def accept(self, c: dict, r: dict, method: str) -> None:
        """A certain match; a size that only one side has, or that differs, is for review."""
        self.pair(c, r, method)
        said, known = c["qualifier"], r["qualifier"]
        if said != known:
            which = "missing" if said is None else "added" if known is None else None
            self.review(f"ingredient qualifier {which}" if which else "ingredient qualifiers conflict", c, [r])

    def first_open(self, names: str, key: str) -> dict | None:
        if names not in self.by_name:
            found = self.by_name[names] = {}
            for r in self.references:
                for name in dict.fromkeys(r[names]):
                    found.setdefault(name, []).append(r)
        able = self.by_name[names].get(key, [])
        while able and able[0]["position"] not in self.open_r:
            able.pop(0)
        return able[0] if able else None


def _by_name(p: _Pairing, names: str, key_of) -> None:
    for c in p.candidates:
        if c["index"] in p.open_c and c["ambiguous_reason"] != NEGATED:
            r = p.first_open(names, key_of(c))
            if r is not None:
                p.accept(c, r, "exact_key")


def _by_alias(p: _Pairing, aliases: dict[str, set[str]], key_of) -> None:
    for c in p.candidates:
        if c["index"] not in p.open_c or c["ambiguous_reason"] is not None:
            continue
        able = [r for r in p.references if r["position"] in p.open_r and key_of(c) in aliases.get(r["key"], ())]
        if len({r["key"] for r in able}) == 1:
            p.accept(c, able[0], "known_alias")
        elif able:
            p.review("alias maps to multiple unmatched references", c, able)


def _by_likeness(p: _Pairing, key_of, accept: float, doubt: float, margin: float) -> set[int]:
    """Fuzzy matches over what is open now; returns candidates left in doubt."""
    unsure: set[int] = set()
    queue = []
    snapshot = list(p.open_r.values())
    # Scores below this neither win, nor rival what wins, nor are shown.
    least = doubt - margin - 1e-6
    for i in sorted(p.open_c):
        c = p.open_c[i]
        if c["ambiguous_reason"] is not None:
            p.review(c["ambiguous_reason"], c)
            continue
        ranked = sorted(
            ((max((similarity(key_of(c), v, least) for v in r["identity_variants"]), default=0.0), r["position"]) for r in snapshot),
            reverse=True,
        )
        if not ranked or ranked[0][0] < doubt:
            continue
        best = ranked[0][0]
        rivals = [p.open_r[at] for s, at in ranked if best - s <= margin]
        if best - (ranked[1][0] if len(ranked) > 1 else 0.0) <= margin:
            unsure.add(i)
            p.review("fuzzy match has competing references", c, rivals)
        elif best >= accept:
            queue += [(s, i, at) for s, at in ranked if s >= accept]
        else:
            unsure.add(i)
            p.review("fuzzy match falls below the acceptance threshold", c, [p.open_r[ranked[0][1]]])
    for s, i, at in sorted(queue, reverse=True):
        if i in p.open_c and at in p.open_r:
            p.pair(p.open_c[i], p.open_r[at], "conservative_fuzzy", s)
    return unsure


def match_lists(
    candidates: list[dict], references: list[dict], aliases: dict[str, set[str]], accept: float, doubt: float, margin: float
) -> tuple[list[dict], list[dict]]:
    """Matches and reviews of one response: exact names, identities, aliases, then likeness, then what is left."""

    def key_of(c: dict) -> str:
        return c["identity_key"] or c["normalized_key"]

    p = _Pairing(candidates, references)
    _by_name(p, "variants", lambda c: c["normalized_key"])
    _by_name(p, "identity_variants", key_of)
    _by_alias(p, aliases, key_of)
    unsure = _by_likeness(p, key_of, accept, doubt, margin)
    for i in sorted(p.open_c):
        c = p.open_c[i]
        p.add(c, None, "ambiguous" if i in unsure else "unmatched", reason=c["ambiguous_reason"])
    for at in sorted(p.open_r):
        p.add(None, p.open_r[at], "unmatched")
    last = float("inf")

    def place(m: dict) -> tuple:
        i, at = m["candidate_index"], m["reference_position"]
        return (last if i is None else i, last if at is None else at)

    return sorted(p.matches, key=place), p.reviews


def match(
    responses: DataFrame,
    *,
    alias_table: AliasTable | None = None,
    fuzzy_threshold: float = fixed.FUZZY_THRESHOLD,
    ambiguity_threshold: float = fixed.AMBIGUITY_THRESHOLD,
    tie_margin: float = fixed.TIE_MARGIN,
) -> DataFrame:
    """Rows with arrays ``candidates`` and ``references`` get arrays ``matches`` and ``reviews``."""
    if not 0 <= ambiguity_threshold <= fuzzy_threshold <= 1:
        raise ValueError("thresholds must satisfy 0 <= ambiguity <= fuzzy <= 1")
    if tie_margin < 0:
        raise ValueError("the tie margin must not be negative")
    aliases = alias_table.keys(responses.sparkSession) if alias_table else {}

    @F.arrow_udf(f"struct<matches: array<{MATCH}>, reviews: array<{REVIEW}>>")
    def found(*columns: pa.Array) -> pa.Array:
        matches, reviews = [], []
        candidates, references = _dicts(OF_CANDIDATE, columns[: len(OF_CANDIDATE)]), _dicts(OF_REFERENCE, columns[len(OF_CANDIDATE) :])
        for c, r in zip(candidates, references, strict=True):
            m, v = match_lists(c, r, aliases, fuzzy_threshold, ambiguity_threshold, tie_margin)
            matches.append(m)
            reviews.append(v)
        return pa.StructArray.from_arrays([_lists(matches, MATCHES), _lists(reviews, REVIEWS)], ["matches", "reviews"])

    # Only what the kernel reads goes to Python, a field at a time; the rows stay.
    fields = [F.col("candidates")[x] for x in OF_CANDIDATE] + [F.col("references")[x] for x in OF_REFERENCE]
    # Not deterministic in name only: the planner would otherwise run it once for matches and again for reviews.
    made = responses.withColumn("_found", found.asNondeterministic()(*fields))
    return made.withColumns({"matches": F.col("_found.matches"), "reviews": F.col("_found.reviews")}).drop("_found")


OF_CANDIDATE = ["index", "raw", "normalized_key", "identity_key", "ambiguous_reason", "qualifier"]
OF_REFERENCE = ["position", "ingredient_text", "key", "variants", "identity_variants", "qualifier"]


def _dicts(names: list[str], columns: Sequence[pa.Array]) -> Iterator[list[dict]]:
    """Each row's structs as dicts, from an array of lists for each field; none for a null list."""
    flat = [dict(zip(names, values, strict=True)) for values in zip(*(c.flatten().to_pylist() for c in columns), strict=True)]
    at = 0
    for n in pc.fill_null(pc.list_value_length(columns[0]), 0).to_pylist():
        yield flat[at : at + n]
        at += n


def _lists(rows: list[list[dict]], of: pa.ListType) -> pa.Array:
    """Lists of dicts as an array, built a field at a time."""
    flat = [x for row in rows for x in row]
    fields = [pa.array([x[f.name] for x in flat], f.type) for f in of.value_type]
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(of.value_type)))


_TEXT = pa.string()
MATCHES = pa.list_(
    pa.struct(
        [
            ("candidate_index", pa.int32()),
            ("reference_position", pa.int32()),
            ("method", _TEXT),
            ("score", pa.float64()),
            ("candidate_evidence", _TEXT),
            ("reference_evidence", _TEXT),
            ("reason", _TEXT),
        ]
    )
)
REVIEWS = pa.list_(pa.struct([("reason", _TEXT), ("candidate_evidence", _TEXT), ("reference_evidence", pa.list_(_TEXT))]))


def match_kth_occurrence(
    candidates: DataFrame, references: DataFrame, group: list[str], key: str, candidate_order: list[str], reference_order: list[str]
) -> DataFrame:
    """The k-th candidate of a key with the k-th reference of that key, in each group: an equi-join, fully native.

    Equals exact matching where every reference has one name. A full outer join: either side may be missing.
    """
    nth = lambda order: F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return candidates.withColumn("_nth", nth(candidate_order)).join(
        references.withColumn("_nth", nth(reference_order)), [*group, key, "_nth"], "full"
    ).drop("_nth")
