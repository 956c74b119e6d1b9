"""Checks, reports, planning, events, stores, configuration and streams on small tables."""

from __future__ import annotations

import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.functions.register import register
from assayer.operators import checks, events, planning, report
from assayer.sources import config, recipes, stores
from assayer.streaming import attempts


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_checks(spark):
    parents = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "k int, declared int")
    children = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (3, 3, "a"), (9, 1, "b"), (None, 1, "c")], "k int, position int, label string")
    assert values(checks.counted_children(parents, children, "k", "k"), "k", "n") == [(1, 2), (2, 0), (3, 1)]
    assert checks.count_mismatches(parents, children, "k", "k", "declared").count() == 0
    assert values(checks.orphans(children, "k", parents, "k"), "k") == [(9,)]
    assert values(checks.not_contiguous(children, ["k"], "position"), "k") == [(3,)]
    assert values(checks.dependency_violations(children, ["k"], ["label"]), "k", "variants") == [(1, 2)]
    assert values(checks.first_appearance(children.filter("k = 1"), ["k"], "label", "position"), "label", "rank") == [("a", 1), ("b", 2)]
    assert values(checks.reconcile({"c": 5, "p": 4}, {"c": children, "p": parents}), "table", "actual") == [("p", 3)]
    texts = spark.createDataFrame(
        [("True", "https://x.org/a"), (" false ", "ftp://x.org"), ("yes", "no url"), (None, "http://"), ("1", None)], "b string, u string"
    )
    assert [r[0] for r in texts.select(checks.strict_boolean(F.col("b"))).collect()] == [True, False, None, None, None]
    assert checks.not_boolean(texts, "b").count() == 2 and checks.bad_urls(texts, "u").count() == 4
    bins = spark.range(21).select(checks.complexity_score(F.col("id")).alias("s")).collect()
    assert [bins[i].s for i in (7, 8, 10, 11, 14, 15, 18, 19)] == [1, 2, 2, 3, 3, 4, 4, 5]


def test_grouped_report(spark):
    df = spark.createDataFrame([("m", "r", "p", 1), ("m", "s", "p", 2), ("n", "r", "q", 4)], "m string, r string, p string, v int")
    got = values(report.grouped(df, "m", "r", "p", [F.sum("v").alias("v")]), "grouping_set", "label", "v")
    assert (6, "p", 3) in got and (2, "m | p", 3) in got and (4, "s | p", 2) in got and (0, "n | r | q", 4) in got
    assert len(got) == 2 + 2 + 3 + 3


def test_containment_needs_no_whole_words_at_the_edges(spark):
    texts = spark.createDataFrame([(1, "xx alpha beta gamma delta eps yy"), (2, "Alpha  BETA gamma"), (3, "none"), (4, "pre7up")], "t int, text string")
    parts = spark.createDataFrame([(1, "ha beta gamma delta ep"), (2, "alpha beta gamma"), (3, "7up"), (4, "beta gam"), (5, "  ")], "p int, part string")
    got = values(report.containing(texts, parts, "t", "p", "text", "part"), "t", "p")
    assert got == [(1, 1), (1, 2), (1, 4), (2, 2), (2, 4), (4, 3)]


def test_piped_answers(spark):
    given = ["Here is the list 1/2 cup | cocoa powder\n1 cup | sugar", "150ml | milk", "unknown | salt", "2 cups flour", "1 cup | 1 cup rice"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    rows = df.select("i", report.adapt_rows(F.col("g")).alias("a"), report.compliant(F.col("g")).alias("c")).orderBy("i").collect()
    assert [r.a for r in rows] == ["1/2 cup cocoa powder\n1 cup sugar", "150 ml milk", "salt", "2 cups flour", "1 cup rice"]
    assert [r.c for r in rows][2:4] == [True, False]


def test_planning(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases = planning.expand(
        one([(0, "r1"), (1, "r2")], "ordinal int, recipe_id string"),
        one([(0, "a", None), (1, "b", "x")], "ordinal int, prompt_id string, tool_profile string"),
        one([(0, "m")], "ordinal int, model_id string"),
        one([(0, "x"), (1, "y")], "ordinal int, tool_profile_id string"),
        2,
    )
    assert cases.count() == 2 * 3 * 2
    fields = {"b": "é", "a": 1, "c": None}
    df = one([(1, "é", None)], "a int, b string, c string")
    made = df.select(planning.case_id(planning.canonical_json(list(fields))).alias("i"), planning.case_id(planning.canonical_json_exact(list(fields))).alias("j")).first()
    want = "case_" + hashlib.sha256(json.dumps({"a": 1, "b": "é"}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert made.i == made.j == want
    cost = df.select(planning.cost_estimate(F.lit(1000), F.lit(400), F.lit("0.15"), F.lit("0.6")).alias("c")).first().c
    assert str(cost).rstrip("0") == "0.00039"
    prompts = one([("c1", "r1", "modern_title_only", "List: 1 cup  FLOUR please"), ("c2", "r1", "assisted", "1 cup flour"), ("c3", "r2", "modern_title_only", "1 cup flour")], "case_id string, recipe_id string, context_group string, rendered_prompt string")
    protected = one([("r1", "2 eggs\n1 cup flour"), ("r2", "salt and pepper")], "recipe_id string, reference_text_exact string")
    assert values(planning.leaks(prompts, protected), "case_id", "recipe_id") == [("c1", "r1")]
    models = one([("m", "P", 1.0, 1.0, ["seed"]), ("n", "P", 1.0, 1.0, []), ("o", "Q", 1.0, 1.0, []), ("q", "p", 1.0, 1.0, ["seed", "top"])], "model_id string, provider string, max_input_price double, max_output_price double, required_parameters array<string>")
    ends = one([("m", "p", 0, "0.5", "2", ["seed"]), ("q", "P", 0, "0.5", "1", ["seed"]), ("o", "Q", -1, "0", "0", [])], "model_id string, provider_name string, status int, input_price string, output_price string, supported_parameters array<string>")
    got = planning.preflight(models, models.filter("model_id <> 'n'").select("model_id"), ends)
    assert values(got, "model_id", "problem") == [("m", "price above ceiling"), ("n", "model not in catalog"), ("o", "provider not available"), ("q", "parameter not supported")]


def _log(run):
    def event(kind, attempt=None, **more):
        return {"event": kind, "run_id": run, "attempt_id": attempt, "recorded_at": more.pop("at", "2026-01-01T00:00:00+00:00"), **more}

    policy = {"allow_fallbacks": False, "data_collection": "deny", "only": ["maker"]}
    case = lambda r: {"case_id": f"case_{r}", "recipe_id": r, "model_requested": "m", "prompt_template_id": "p", "prompt_template_version": "1", "provider_policy": policy, "parameters": {"max_tokens": 9, "temperature": 0}}
    return [
        event("run_started"),
        event("attempt_started", "a1", case=case("r1"), attempt_number=1),
        event("attempt_failed", "a1", status_code=429, transient=True, will_retry=True, reported_cost_usd="0.25", at="2026-01-01T00:00:01+00:00"),
        event("attempt_started", "a2", case=case("r1"), attempt_number=2, retry_of_attempt_id="a1"),
        event("attempt_succeeded", "a2", finish_reason="stop", provider_actual="Maker", reported_cost_usd="0.5", at="2026-01-01T00:00:02+00:00"),
        event("attempt_started", "a3", case=case("r2"), attempt_number=1),
        event("attempt_succeeded", "a3", finish_reason="length", provider_actual="Maker", reported_cost_usd="0.5", at="2026-01-01T00:00:03+00:00"),
        event("run_completed"),
    ]


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for run in ("one", "two"):
        rows = _log(run) if run == "one" else _log(run)[:-1]
        (folder / f"{run}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(folder)


def test_events(spark, log):
    e = events.read_events(spark, log).cache()
    rows = events.attempts(e)
    assert rows.count() == 6 and events.unstarted(e).count() == 0 and events.open_runs(e).count() == 1
    got = values(events.run_summary(rows), "attempts", "succeeded", "failed", "cost")
    assert [(a, b, c, float(d)) for a, b, c, d in got] == [(3, 2, 1, 1.25)] * 2
    wanted = rows.filter("attempt_id = 'a2'").select("case.provider_policy", "case.parameters").limit(1)
    requested = wanted.crossJoin(spark.createDataFrame([("r2",), ("r9",)], "recipe_id string")).selectExpr(
        "recipe_id", "'m' AS model_id", "'p' AS prompt_id", "'1' AS prompt_version", "'maker' AS provider", "provider_policy AS policy", "parameters"
    )
    first = rows.filter(F.col("run_file").endswith("one.jsonl"))
    assert values(events.match_baseline(requested, first), "recipe_id", "state") == [("r2", "ineligible_finish_reason"), ("r9", "missing")]
    e.unpersist()
    open(f"{log}/bad.jsonl", "w").write("[1]\n{oops\n")
    assert events.read_events(spark, log, strict=False).count() == 15
    with pytest.raises(Exception, match="malformed event"):
        events.read_events(spark, log).collect()


def test_reported_cost(spark):
    given = ['{"cost": 0.5, "total_cost": 2}', '{"cost": true, "total_cost": "1.5"}', "3", '{"cost": null}', '{"cost": "x"}']
    df = spark.createDataFrame([(g,) for g in given], "u string")
    got = [r[0] for r in df.select(events.reported_cost(F.parse_json("u"))).collect()]
    assert [None if g is None else float(g) for g in got] == [0.5, 1.5, 3.0, None, None]


def test_streams_equal_batches(spark, log, tmp_path):
    stream = attempts.stream_events(spark, log, 1)
    query = attempts.budget_ledger(stream, 1.0, 0.5).writeStream.format("memory").queryName("ledger").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = values(spark.table("ledger"), "run_id", "attempt_id", "spent_before", "dispatched")
    assert got == [(r, *x) for r in ("one", "two") for x in (("a1", 0.0, True), ("a2", 0.25, True), ("a3", 0.75, False))]
    batch = events.attempts(events.read_events(spark, log)).filter("event IS NOT NULL").withColumn("cost", F.col("reported_cost_usd").cast("double"))
    rows = events.budget_stop(batch, "run_id", ["ended_at"], "cost", F.lit(0.5), F.lit(1.0))
    assert values(rows, "run_id", "attempt_id", "spent_before", "dispatched") == got
    sink = attempts.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
    sink.awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 15
    windows = attempts.outcome_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    windows.processAllAvailable()
    windows.stop()
    assert values(spark.table("windows"), "event", "attempts") == [("attempt_failed", 2), ("attempt_succeeded", 4)]


def test_wide_file(spark, tmp_path):
    def record(i, **more):
        return {"position": i, "section": "", "text_exact": f"1 cup x{i}", "quantity_text_exact": "1 cup", "ingredient_text": f"x{i}", "ingredient_key": f"x{i}", "tier": "primary", "optional": False, "subrecipe_reference": False} | more

    good = [record(1), record(2, quantity_text_exact="")]
    bad = [record(1, tier="top"), record(3, extra=1)]
    rows = [("good", good, "2", "1 cup x1\n1 cup x2"), ("bad", bad, "3", "text")]
    path = tmp_path / "wide.csv"
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["recipe_id", "ingredient_records_json", "ingredient_count", "reference_text_exact", "reference_sha256", "rating_urls", "score"])
        for k, r, n, t in rows:
            w.writerow([k, json.dumps(r), n, t, hashlib.sha256(t.encode()).hexdigest() if k == "good" else "x", json.dumps(["u1", "u2"]) if k == "good" else "{}", "4"])
    df = recipes.read_wide_csv(spark, str(path), ["recipe_id", "score"])
    assert df.count() == 2
    assert values(recipes.ingredients(df).filter("recipe_id = 'good'"), "position", "section", "quantity_text_exact") == [(1, None, "1 cup"), (2, None, None)]
    assert values(recipes.listed(df, "rating_urls", "url"), "position", "url") == [(1, "u1"), (2, "u2")]
    assert values(recipes.not_lists(df, ["rating_urls", "ingredient_records_json"], "recipe_id"), "recipe_id", "field") == [("bad", "rating_urls")]
    assert values(recipes.ratings(df, ["score"], "v1"), "recipe_id", "dimension", "score") == [("bad", "score", 4), ("good", "score", 4)]
    assert values(recipes.record_issues(df), "recipe_id", "issue") == [("bad", x) for x in ("ingredient count", "positions not contiguous", "record keys", "text digest", "unknown tier")]
    with pytest.raises(ValueError, match="missing columns: gone"):
        recipes.read_wide_csv(spark, str(path), ["gone"])


def test_stores(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(50)])
    spark.dataSource.register(stores.SqliteSource)
    scan = spark.read.format("sqlite_ro").schema("id bigint, name string").option("path", str(tmp_path / "s.db"))
    assert scan.option("table", "t").load().count() == 50
    split = scan.option("table", "t").option("partition_column", "id").option("lower", 0).option("upper", 49).option("partitions", 4).load()
    assert split.rdd.getNumPartitions() == 4 and split.agg(F.sum("id")).first()[0] == 1225
    place = str(tmp_path / "published")
    stores.publish(spark, {"a": spark.range(3)}, place, lambda t: None)

    def refuse(tables):
        raise ValueError("not good")

    with pytest.raises(ValueError, match="not good"):
        stores.publish(spark, {"a": spark.range(9)}, place, refuse)
    assert spark.read.parquet(f"{place}/a").count() == 3
    stores.publish(spark, {"a": spark.range(9)}, place, lambda t: None)
    assert spark.read.parquet(f"{place}/a").count() == 9 and [p.name for p in tmp_path.iterdir() if "published" in p.name] == ["published"]
    stores.append_json(spark.range(2), f"{place}/j")
    stores.append_json(spark.range(2), f"{place}/j")
    assert spark.read.json(f"{place}/j").count() == 4


def _config():
    return {
        "schema_version": 1, "experiment_id": "exp-1", "max_budget_usd": "0.5", "repetitions": 2, "recipes": ["r1", "r2"],
        "prompts": [{"id": "p", "version": 1, "context_group": "modern_title_only", "template": "List {recipe_name}"}],
        "models": [{"id": "maker/m", "routing": {"only": ["maker"]}, "max_output_tokens": 9, "pricing_ceiling": {"input": "1", "output": "2"}}],
    }


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"extra": 1}, "unknown extra"),
        ({"repetitions": 0}, "whole number"),
        ({"recipes": ["r", "r"]}, "recipes repeat"),
        ({"max_budget_usd": "-1"}, "no amount"),
        ({"experiment_id": "Bad Id"}, "bad identifier"),
        ({"prompts": [{"id": "p", "version": 1, "context_group": "x", "template": "{other}"}]}, "unknown field other"),
    ],
)
def test_config_is_strict(change, said):
    with pytest.raises(ValueError, match=said):
        config.check(_config() | change)


def test_config_tables(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(_config()))
    _, tables = config.load(spark, str(tmp_path / "c.yaml"))
    assert planning.expand(tables["recipes"], tables["prompts"], tables["models"], tables["tool_profiles"], 2).count() == 4


def test_sql_functions(spark):
    register(spark)
    odd = spark.createDataFrame([("1½ cups  flour\r\n x",), ("ﬁne ¼½ 2⁄3",)], "t string").withColumn("a", F.expr("norm_text(t)")).withColumn("b", text.normalized(F.col("t"))).collect()
    assert [r.a for r in odd] == [r.b for r in odd] and odd[0].a == "1 1/2 cups flour\nx"
    r = spark.sql("SELECT norm_text('ﬁne   x') AS a, seq_ratio('chiken stock', 'chicken stock') AS b, case_id('{}') AS c").first()
    assert (r.a, round(r.b, 2), r.c) == ("fine x", 0.96, "case_" + hashlib.sha256(b"{}").hexdigest())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_outputs_and_generations(spark):
    raw = ['{"output_text": "a"}', '{"raw_response": {"choices": [{"message": {"content": "b"}}]}}']
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(F.parse_json("r").alias("raw"))
    assert [r.output for r in events.output_text(df).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="one output"):
        events.output_text(spark.createDataFrame([("{}",)], "r string").select(F.parse_json("r").alias("raw"))).collect()
    rows = spark.createDataFrame([("g1", "x"), ("g2", "y"), (None, "z")], "generation_id string, provider_actual string")
    known = spark.createDataFrame([("g1", "Maker", None)], "generation_id string, provider_name string, metadata_error string")
    got = values(events.with_generation(rows, known), "provider_actual", "metadata_error")
    assert got == [("Maker", None), ("y", "no metadata"), ("z", None)]


def test_transcriptions(spark, tmp_path):
    (tmp_path / "book.md").write_text("# Book\n\n## One\n\nnote\n\n```text\n1 cup a\n\n2 b\n```\n\n## Two\n\n```text\nc\n```\n")
    assert values(recipes.read_transcriptions(spark, str(tmp_path)), "title", "text") == [("One", "1 cup a\n\n2 b"), ("Two", "c")]
