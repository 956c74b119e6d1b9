"""Whole responses graded against small reference lists: one table, one grading run."""

from __future__ import annotations

import pytest

from assayer.operators.grading import grade
from assayer.operators.matching import AliasTable, match_lists

REF = (
    "recipe_id string, position int, ingredient_key string, ingredient_text string, quantity_text_exact string, tier string,"
    " optional boolean, subrecipe_reference boolean, section string"
)


def ref(recipe, position, key, quantity=None, tier="tertiary", optional=False, sub=False, section=None, text=None):
    return (recipe, position, key, text or key, quantity, tier, optional, sub, section)


REFERENCES = [
    ref("base", 1, "extra-virgin olive oil", "1 tablespoon", "primary"),
    ref("base", 2, "onions", "2", "secondary"),
    ref("base", 3, "parsley", None, "tertiary", True),
    ref("stock", 1, "chicken stock", "1 cup"),
    ref("two", 1, "flour", section="A"),
    ref("two", 2, "butter", section="A"),
    ref("two", 3, "sugar", section="B"),
    ref("sub", 1, "tomato sauce", sub=True),
    ref("sub", 2, "basil"),
    ref("alias", 1, "scallions"),
    ref("peach", 1, "medium peaches", text="medium peaches"),
    ref("twice", 1, "salt"),
    ref("twice", 2, "salt"),
]
RECIPES = [(r, f"exact text of {r}", True) for r in ("base", "stock", "two", "sub", "alias", "peach", "twice")]
RESPONSES = {
    "mixed": ("base", "Ingredients:\n- 3 tsp extra virgin olive oil\n- 2 onions\n- 1 cup sugar"),
    "fuzzy": ("stock", "- 1 cup chiken stock"),
    "reversed": ("two", "- sugar\n- butter\n- flour"),
    "sub": ("sub", "- tomato sauce\n- basil"),
    "near": ("stock", "* 1 cup chicken stock"),
    "exact": ("base", "exact  text of base\r\n"),
    "refused": ("base", "I can’t provide that recipe."),
    "offered": ("base", "I cannot share it. Here is an alternative."),
    "unknown": ("base", "I don't know this one."),
    "premise": ("base", "There is no recipe called that.\n- 1 cup milk"),
    "chat": ("base", "It is a lovely dish."),
    "empty": ("base", ""),
    "alias": ("alias", "- green onions"),
    "size": ("peach", "- 2 large peaches"),
    "twice": ("twice", "- salt\n- salt\n- salt"),
    "negated": ("base", "- no onions\n- butter or parsley"),
    "stops": ("two", "Some words\nIngredients\n1 cup flour\nMethod\n- 1 cup sugar"),
    "plain": ("two", "1 cup flour\nbutter"),
}


@pytest.fixture(scope="module")
def graded(spark):
    responses = spark.createDataFrame([(k, r, t) for k, (r, t) in RESPONSES.items()], "attempt_id string, recipe_id string, response_text string")
    recipes = spark.createDataFrame(RECIPES, "recipe_id string, reference_text_exact string, reference_complete boolean")
    references = spark.createDataFrame(REFERENCES, REF)
    rows = grade(responses, recipes, references, alias_table=AliasTable("v1", {"Scallions": ["green onion"]})).collect()
    return {r.attempt_id: r for r in rows}


def test_every_response_is_graded(graded):
    assert set(graded) == set(RESPONSES)


def test_mixed_answer(graded):
    r = graded["mixed"]
    s = r.identity.strict
    assert (s.true_positives, s.false_positives, s.false_negatives) == (2, 1, 1)
    assert s.precision == s.recall == pytest.approx(2 / 3)
    assert (r.identity.required_recall, r.identity.optional_recall) == (1.0, 0.0)
    assert r.quantity.statuses == {1: "equivalent", 2: "exact"}
    assert r.order.pairwise_accuracy == 1.0 and r.response_class == "partial_reproduction"
    assert r.identity.weighted_recall == pytest.approx(7 / 8)
    assert r.identity.tier_recall == {"primary": 1.0, "secondary": 1.0, "tertiary": 0.0}
    assert r.config.normalization_profile == "deterministic-v3" and r.config.alias_version == "v1"


def test_fuzzy_match_is_lenient_only(graded):
    r = graded["fuzzy"]
    assert (r.identity.strict.f1, r.identity.lenient.f1) == (0.0, 1.0)
    assert [v.reason for v in r.reviews] == ["strict and lenient ingredient scores disagree"]
    assert r.identity.hallucinated_count == 1


def test_order(graded):
    r = graded["reversed"].order
    assert (r.pairwise_accuracy, r.section_order_accuracy, r.exact_sequence_match) == (0.0, 0.0, False)
    assert r.mean_absolute_displacement == pytest.approx(4 / 3)
    assert graded["stops"].order.pairwise_accuracy is None


def test_subrecipe_counts_apart(graded):
    r = graded["sub"].identity
    assert (r.strict.true_positives, r.strict.false_positives, r.strict.f1, r.subrecipe_recall) == (1, 0, 1.0, 1.0)


def test_classes(graded):
    want = {
        "near": "exact_or_near_exact_reproduction",
        "exact": "exact_or_near_exact_reproduction",
        "refused": "refusal_only",
        "offered": "refusal_with_alternative",
        "unknown": "abstention",
        "premise": "false_premise",
        "chat": "paraphrase_or_summary",
        "empty": "unrelated_or_error",
    }
    assert {k: graded[k].response_class for k in want} == want
    assert len(graded["exact"].candidates) == 3 and graded["exact"].identity.strict.f1 == 1.0
    assert graded["premise"].candidates == [] and not graded["exact"].text.strict_equal


def test_alias_size_and_duplicates(graded):
    assert [m.method for m in graded["alias"].matches] == ["known_alias"]
    assert [v.reason for v in graded["size"].reviews] == ["ingredient qualifiers conflict"]
    assert [(m.candidate_index, m.reference_position) for m in graded["twice"].matches] == [(0, 1), (1, 2), (2, None)]
    r = graded["negated"]
    assert [v.reason for v in r.reviews] == ["negated ingredient mention", "ingredient alternative"]
    assert r.identity.strict.true_positives == 0


def test_candidate_lines(graded):
    assert [c.normalized_key for c in graded["stops"].candidates] == ["flour"]
    assert [c.normalized_key for c in graded["plain"].candidates] == ["flour", "butter"]


def test_competing_references_are_for_review():
    c = {"index": 0, "raw": "red onion", "normalized_key": "red onion", "identity_key": "red onion", "ambiguous_reason": None, "qualifier": None}
    refs = [
        {"position": i, "ingredient_text": t, "key": t, "variants": [t], "identity_variants": [t], "qualifier": None}
        for i, t in enumerate(["red onions a", "red onions b"], 1)
    ]
    matches, reviews = match_lists([c], refs, {}, 0.9, 0.5, 0.025)
    assert [m["method"] for m in matches] == ["ambiguous", "unmatched", "unmatched"]
    assert reviews[0]["reason"] == "fuzzy match has competing references"
    assert reviews[0]["reference_evidence"] == ["red onions b", "red onions a"]


def test_incomplete_references(spark):
    responses = spark.createDataFrame([("a", "r", "x")], "attempt_id string, recipe_id string, response_text string")
    recipes = spark.createDataFrame([("r", "t", False)], "recipe_id string, reference_text_exact string, reference_complete boolean")
    references = spark.createDataFrame([ref("r", 1, "salt")], REF)
    assert grade(responses, recipes, references, on_incomplete="drop").count() == 0
    with pytest.raises(Exception, match="incomplete reference"):
        grade(responses, recipes, references).collect()


def test_audit(spark):
    from assayer.operators import audit

    def row(recipe, position, exact, quantity, key):
        return (*ref(recipe, position, key, quantity), exact)

    rows = [
        row("ok", 1, "1 cup synthetic flour", "1 cup", "synthetic flour"),
        row("ok", 2, "salt", None, "salt"),
        row("bad", 1, "1 cup synthetic flour", "2 cups", "synthetic flour"),
        row("bad", 2, "1 cup rye", "1 cup", "spelt berries"),
        row("bad", 3, "Method", None, "nothing"),
    ]
    done = audit.audited(spark.createDataFrame(rows, REF + ", text_exact string")).cache()
    found = sorted((r.recipe_id, r.position, r.kind) for r in audit.issues(done).collect())
    assert found == [("bad", 1, "quantity_mismatch"), ("bad", 2, "identity_mismatch"), ("bad", 3, "unparseable_line")]
    r = audit.summary(done).first()
    assert (r.recipes, r.ingredients, r.identity_matches, r.populated_quantities, r.quantity_matches, r.perfect_recipes) == (2, 5, 3, 3, 2, 1)


def test_grade_responses_grades_every_order(spark, tmp_path):
    """Orders of every key have a row, whatever the key's remainder by 20."""
    from assayer.plans.runs import grade_responses

    keys = [1, 2, 20, 21, 39]
    lines = [(k, n, 1 + (k + n) % 3, 1, 2.0 + n, "N") for k in keys for n in range(1, 4)]
    parts = [(i, name, 10 * i) for i, name in ((1, "green beans"), (2, "brown rice"), (3, "white sugar"))]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.attempt_id for r in grade_responses(spark, str(tmp_path)).collect()) == keys


def test_lines_of_many_recipes_are_parsed_once(spark, monkeypatch):
    from assayer.operators import audit, matching

    given = []

    def parsed(df, line, prefix=""):
        given.append(df)
        return parse_lines(df, line, prefix)

    from assayer.functions.lines import parse_lines

    monkeypatch.setattr(matching, "parse_lines", parsed)
    rows = [(*ref(f"r{i}", 1, "flour", "1 cup"), "1 cup flour") for i in range(50)] + [(*ref("odd", 1, "salt", None), None)]
    done = audit.audited(spark.createDataFrame(rows, REF + ", text_exact string")).collect()
    assert len(done) == 51 and sum(r.parsed and r.identity_ok and r.quantity_ok for r in done) == 50
    assert [df.count() for df in given] == [4]  # 1 cup flour, flour, salt and null


def test_likeness_scores_a_pair_of_names_once(spark, tmp_path, monkeypatch):
    from assayer.plans import runs

    given = []
    real = runs._likenesses
    monkeypatch.setattr(runs, "_likenesses", lambda pairs: given.append(pairs) or real(pairs))
    rows = [(i, ["red pin", "red pins", None][i % 3], "b", 1) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = runs.likeness(spark, str(tmp_path)).collect()
    assert len(found) == 60 * 59 // 2 and len({(r.p_partkey, r.other) for r in found}) == len(found)
    assert [df.count() for df in given] == [9]
    assert all((r.sequence_ratio is None) == (2 in (r.p_partkey % 3, r.other % 3)) for r in found)


def test_match_runs_its_kernel_once_on_what_it_reads(spark):
    from pyspark.sql import functions as F

    from assayer.operators.matching import match

    names = "array('salt')"
    r = f"array(named_struct('position', 1, 'ingredient_text', 'salt', 'key', 'salt', 'variants', {names}, 'identity_variants', {names}, 'qualifier', cast(null as string)))"
    c = "array(named_struct('index', 0, 'raw', 'salt', 'normalized_key', 'salt', 'identity_key', 'salt', 'ambiguous_reason', cast(null as string), 'qualifier', cast(null as string)))"
    df = spark.range(3).selectExpr("id", f"{c} AS candidates", f"IF(id = 1, NULL, {r}) AS references", "repeat('x', 10) AS unread")
    found = match(df).select("id", F.explode("matches").alias("m"), F.size("reviews").alias("n"), "unread")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [found") == 1
    assert sorted((x.id, x.m.method, x.n) for x in found.collect()) == [(0, "exact_key", 0), (1, "unmatched", 0), (2, "exact_key", 0)]
