"""Text, quantity and line functions on the worked examples and on edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import lines, quantity, text


def column(spark, values, make):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], _schema(values))
    return [r.out for r in df.withColumn("out", make(df)).orderBy("i").collect()]


def _schema(values):
    n = len(values[0]) if isinstance(values[0], tuple) else 1
    return "i int, " + ", ".join(f"c{k} string" for k in range(n))


def test_text_forms(spark):
    got = column(
        spark,
        ["1½ cups  flour\r\n", "½⅓ x", " a b\x1cc   d\n", "", None, "ﬁne ﬂour", "1⁄2", "٣½"],
        lambda df: text.normalized(df.c0),
    )
    assert got == ["1 1/2 cups flour", "1/2 1/3 x", "a b\nc\n\nd".replace("\n\n", "\n"), "", None, "fine flour", "1/2", "٣ 1/2"]
    assert column(spark, ["Straße  É\nx"], lambda df: text.folded(df.c0)) == ["strasse é x"]


KEYS = [
        ("Extra-Virgin Olive Oils", "extra virgin olive oil"),
        ("Salt & Pepper", "salt and pepper"),
        ("cookies", "cooky"),
        ("shoes", "sho"),
        ("molasses", "molasse"),
        ("tomatoes", "tomato"),
        ("radishes peaches boxes", "radish peach box"),
        ("glass asparagus basis gas", "glass asparagus basis gas"),
        ("knives, halves; loaves", "knife half loaf"),
        ("crème fraîche (thick)", "crème fraîche thick"),
        ("", ""),
    ]


def test_ingredient_keys(spark):
    assert column(spark, [k for k, _ in KEYS], lambda df: text.ingredient_key(df.c0)) == [w for _, w in KEYS]


def test_units(spark):
    got = column(spark, ["T", "tbs.", " Cups ", "lbs", "stone", None], lambda df: text.unit(df.c0))
    assert got == ["teaspoon", "tablespoon", "cup", "pound", None, None]


QUANTITIES = [
        ("1 1/2 cups", ("1 1/2 cups", 3, 2, None, None, "cup", None)),
        ("1½ cups", ("1 1/2 cups", 3, 2, None, None, "cup", None)),
        ("2 to 3", ("2 to 3", 2, 1, 3, 1, None, None)),
        ("about 2–3 tbsp. oil", ("about 2–3 tbsp.", 2, 1, 3, 1, "tablespoon", None)),
        ("1.25 kg", ("1.25 kg", 125, 100, None, None, "kilogram", None)),
        ("One 14½-ounce can tomatoes", ("One 14 1/2-ounce can", 1, 1, None, None, "can", "package:29/2:ounce:can")),
        ("1 bottle (750 ml) dry red wine", ("1 bottle (750 ml)", 1, 1, None, None, "bottle", "package:750:milliliter:bottle")),
        ("Small pinch of saffron", ("Small pinch of saffron", None, None, None, None, None, "small pinch")),
        ("a pinch", ("a pinch", 1, 1, None, None, "pinch", "pinch")),
        ("salt to taste", ("salt to taste", None, None, None, None, None, "to taste")),
        ("4-pound chicken", ("4-pound", 4, 1, None, None, "pound", None)),
        ("2 lbs. fresh spinach", ("2 lbs.", 2, 1, None, None, "pound", None)),
        ("150ml milk", None),
        ("flour", None),
        ("  ", None),
        (None, None),
    ]


def test_quantities(spark):
    got = column(spark, [g for g, _ in QUANTITIES], lambda df: quantity.parse_quantity(df.c0))
    assert [tuple(g) if g else None for g in got] == [w for _, w in QUANTITIES]


PAIRS = [
        ("3 tsp", "1 tbsp", True),
        ("1 cup", "1 gram", False),
        ("3", "2 to 3", True),
        ("4", "2 to 3", False),
        ("2 to 3", "2-3", True),
        ("One 14½-ounce can", "1 14 1/2-oz can", True),
        ("One 14½-ounce can", "One 28-ounce can", False),
        ("One 14½-ounce can", "2 14½-ounce cans", False),
        ("1 pound", "16 oz", True),
        ("1 liter", "1000 ml", True),
        ("48 tsp", "1 cup", True),
        ("1", "1 cup", False),
        ("to taste", "as needed", False),
        (None, None, True),
        ("1", None, False),
    ]


def test_equivalence(spark):
    two = lambda df: quantity.equivalent(quantity.parse_quantity(df.c0), quantity.parse_quantity(df.c1))
    want = [w for _, _, w in PAIRS]
    assert column(spark, [(a, b) for a, b, _ in PAIRS] + [(b, a) for a, b, _ in PAIRS], two) == want + want


def parsed(spark, *given):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, line string")
    return lines.parse_lines(df, "line").orderBy("i").collect()


def test_lines(spark):
    rows = parsed(
        spark,
        "2. 1 1/2 cups yellow onions, finely chopped",
        "- 2 teaspoons (8 g) active dry yeast",
        "- No garlic",
        "- 2 tbsp butter or olive oil",
        "2 to 3 medium peaches, peeled",
        "1 cup medium-grain rice",
        "Ingredients:",
        "- ",
        "2 cups stock (see page 4)",
        "1 cup nuts, optional",
        "salt to taste",
        "4 cups",
        "* 2 stalks celery (about 13 1/2 ounces), diced",
    )
    assert [r.normalized_key for r in rows] == [
        "yellow onion", "active dry yeast", "no garlic", "butter or olive oil", "medium peach", "medium grain rice", None, "",
        "stock", "nut", "salt", None, "celery about 13 1 2 ounce",
    ]
    assert rows[0].modifier == "finely chopped" and rows[0].quantity.raw == "1 1/2 cups"
    assert [rows[i].ambiguous_reason for i in (1, 2, 3)] == [None, "negated ingredient mention", "ingredient alternative"]
    assert (rows[4].identity_key, rows[4].qualifier) == ("peach", "medium")
    assert (rows[5].identity_key, rows[5].qualifier) == ("medium grain rice", None)
    assert rows[10].quantity.category == "to taste"


def test_headings(spark):
    given = ["Ingredients", "## Ingredients:", "**Ingredients**", "Method", "For the sauce:", "2 cups:", "- x:", "plain"]
    kinds = column(spark, given, lambda df: lines.heading_kind(df.c0))
    assert kinds == ["ingredients", "ingredients", None, "stop", None, None, None, None]
    generic = column(spark, given, lambda df: lines.is_section_heading(df.c0))
    assert generic == [False, True, True, False, True, False, False, False]


def test_pair_metrics(spark):
    pairs = [("a b c d", "a c d e"), ("", ""), ("x", ""), ("a b a b", "a b b a b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    two = text.tokens(df.a), text.tokens(df.b)
    got = df.select("i", text.lcs_ratio(*two).alias("l"), text.bigram_overlap(*two).alias("n")).orderBy("i").collect()
    assert [(r.l, r.n) for r in got] == [(0.75, 1), (1.0, 0), (0.0, 0), (0.8, 3)]
    [r] = df.limit(1).select(
        text.sequence_ratio(F.lit("chiken stock"), F.lit("chicken stock")).alias("s"),
        text.ingredient_similarity(F.lit("chiken stock"), F.lit("chicken stock")).alias("m"),
        text.ingredient_similarity(F.lit(""), F.lit("x")).alias("z"),
    ).collect()
    assert (round(r.s, 2), r.m, r.z) == (0.96, r.s, 0.0)
