"""Text normalization as columns. Only NFKC and case folding, which Spark lacks, go through Arrow."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import fixed, let

#: Python's white space, which \s of Java doesn't cover.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: Python's line breaks.
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """Compatibility composition, then full case folding."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none outside."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def fractions(c: Column) -> Column:
    """Vulgar fractions spelled out, set off from a digit before them."""
    signs = "".join(fixed.FRACTIONS)
    c = F.regexp_replace(c, rf"(?U)(?<=[\d{signs}])(?=[{signs}])", " ")
    pairs = ", ".join(f"struct('{sign}' AS k, '{spelled}' AS v)" for sign, spelled in fixed.FRACTIONS.items())
    c = F.aggregate(F.expr(f"array({pairs})"), c, lambda text, p: F.replace(text, p["k"], p["v"]))
    return F.replace(c, F.lit("⁄"), F.lit("/"))


def lines(c: Column) -> Column:
    """The lines of a text; none for an empty one, none after a final break."""
    cut = F.split(c, BREAK)
    last = F.element_at(cut, -1)
    return F.when(last == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def _ascii_or(c: Column, plain: Column, other) -> Column:
    """``plain`` where c is ASCII, which composition and fractions leave alone; only other texts go to Python."""
    is_ascii = F.octet_length(c) == F.char_length(c)
    return F.when(is_ascii, plain).otherwise(other(F.when(~is_ascii, c)))


def normalized(c: Column) -> Column:
    """Layout normalized, line by line, without touching words or numbers."""
    each = F.transform(lines(_ascii_or(c, c, lambda t: nfkc(fractions(t)))), collapse)
    return strip(F.array_join(each, "\n"))


def folded(c: Column) -> Column:
    """``normalized`` text, case folded, on one line."""
    return collapse(_ascii_or(c, F.lower(c), lambda t: nfkc_fold(fractions(t))))


def leakage_form(c: Column) -> Column:
    """What prompts and references are compared in: composed, folded, white space collapsed."""
    return collapse(_ascii_or(c, F.lower(c), nfkc_fold))


def singular(t: Column) -> Column:
    """A token without its plural ending, by rule; the rules' oddities are part of the result."""
    rules = F.when(F.length(t) <= 3, t)
    long = F.length(t) > 4
    rules = (
        F.when(long & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(long & t.endswith("oes"), F.substring(t, F.lit(1), F.length(t) - 2))
        .when(long & t.rlike("(?:ches|shes|xes|zes)$"), F.substring(t, F.lit(1), F.length(t) - 2))
        .when((F.length(t) > 3) & t.endswith("s") & ~t.rlike("(?:ss|us|is)$"), F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )
    for many, one in fixed.IRREGULAR.items():
        rules = F.when(t == many, F.lit(one)).otherwise(rules)
    return rules


def words(c: Column) -> Column:
    """The white-space tokens of collapsed text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def key_of_folded(c: Column) -> Column:
    """The ingredient key of folded text."""
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(c, r"[‐-―-]", " ")
    c = collapse(F.regexp_replace(c, r"(?U)[^\w\s']", " "))
    return F.array_join(F.transform(words(c), singular), " ")


def ingredient_key(c: Column) -> Column:
    return key_of_folded(folded(c))


def unit(c: Column) -> Column:
    """The canonical unit of a spelling, or null."""
    pairs = ", ".join(f"'{s}', '{name}'" for name, spelled in fixed.UNITS.items() for s in spelled)
    table = F.expr(f"map({pairs})")
    return F.try_element_at(table, F.lower(strip(c)))


def tokens(c: Column) -> Column:
    """Folded white-space tokens."""
    return words(folded(c))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Shared bigrams of two token arrays, copies counted: the sum over bigrams of the smaller count."""

    def two(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))

    def shared(x: Column, y: Column) -> Column:
        count = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
        return F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(count(x, g), count(y, g)))

    return let(F.struct(two(a).alias("a"), two(b).alias("b")), lambda s: shared(s["a"], s["b"]))


def lcs_ratio(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays over the longer one's length; 1 for two empty arrays."""

    @F.udf(T.DoubleType(), useArrow=True)
    def ratio(x, y):
        if x is None or y is None:
            return None
        x, y = list(x), list(y)
        if not x and not y:
            return 1.0
        # Bit-parallel: one pass over y with x's positions as bits.
        where: dict[str, int] = {}
        for i, t in enumerate(x):
            where[t] = where.get(t, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for t in y:
            hit = row & where.get(t, 0)
            row = (row + hit | row - hit) & full
        return (len(x) - row.bit_count()) / max(len(x), len(y))

    return ratio(a, b)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity of two strings."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over white-space tokens."""
    return pd.Series(
        [
            None if x is None or y is None else SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio()
            for x, y in zip(a, b, strict=True)
        ],
        dtype="float64",
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two keys' token sets; 0 where either has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def ingredient_similarity(a: Column, b: Column) -> Column:
    """The larger of token F1 and sequence ratio; 0 where a key has no token."""
    none = (F.size(words(a)) == 0) | (F.size(words(b)) == 0)
    return F.when(none, 0.0).otherwise(F.greatest(token_f1(a, b), sequence_ratio(a, b)))
