"""Queries of planning and event operators over the driver's tables, and rows-only ones.

Nations, regions and parts stand in for recipes, prompts and models; each user's events for a run's attempts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import events as ev
from assayer.operators import planning
from assayer.operators.matching import match
from assayer.plans.roles import query, read
from assayer.sources.shared import joined, written


def _matrix(spark, sf_dir):
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    recipes = nations.select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("recipe_id"))
    prompts = regions.select(
        F.col("r_regionkey").alias("ordinal"),
        F.col("r_name").alias("prompt_id"),
        F.concat(F.lit("List {recipe_name} of {cookbook_title}, "), F.col("r_name")).alias("template"),
        F.when(F.col("r_regionkey") % 2 == 0, "plain").alias("tool_profile"),
    )
    key = F.regexp_extract("model_id", r"\d+", 0).cast("long")
    brands = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model_id")).agg(F.min("p_size").alias("p_size"))
    models = brands.select(key.alias("ordinal"), "model_id", "p_size", key.alias("model_key"))
    profiles = spark.createDataFrame([(0, "plain"), (1, "search")], "ordinal int, tool_profile_id string")
    cases = planning.expand(recipes, prompts, models, profiles, 2)
    return cases.withColumn("rendered_prompt", planning.render(F.col("template"), F.col("recipe_id"), F.col("prompt_id")))


MATRIX = """
    WITH matrix AS (
        SELECT n_name AS recipe_id, n_nationkey, r_name AS prompt_id, r_regionkey, profile AS tool_profile_id, model_key, model_id, p_size, repetition,
               'List ' || n_name || ' of ' || r_name || ', ' || r_name AS rendered_prompt
        FROM nation CROSS JOIN region CROSS JOIN (SELECT unnest(['plain', 'search']) AS profile)
        CROSS JOIN (SELECT p_brand AS model_id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS model_key, min(p_size) AS p_size FROM part GROUP BY 1, 2) CROSS JOIN (SELECT unnest([1, 2])::INTEGER AS repetition)
        WHERE r_regionkey % 2 <> 0 OR profile = 'plain')
"""


@query(MATRIX + "SELECT recipe_id, prompt_id, model_key, tool_profile_id, repetition, rendered_prompt FROM matrix")
def plan_matrix(spark, sf_dir):
    """Every case of a plan; some prompts pin their tool profile."""
    return _matrix(spark, sf_dir).select("recipe_id", "prompt_id", "model_key", "tool_profile_id", "repetition", "rendered_prompt")


@query(
    MATRIX
    + """
    SELECT 'case_' || sha256('{"model":"' || model_id || '","profile":"' || tool_profile_id || '","prompt":"' || rendered_prompt || '","recipe":"' || recipe_id || '","repetition":' || repetition || '}') AS case_id,
           count(*) AS n FROM matrix GROUP BY 1
"""
)
def case_ids(spark, sf_dir):
    """Content-addressed ids of the plan's cases."""
    named = _matrix(spark, sf_dir).select(
        F.col("model_id").alias("model"), F.col("tool_profile_id").alias("profile"), F.col("rendered_prompt").alias("prompt"),
        F.col("recipe_id").alias("recipe"), "repetition",
    )
    made = planning.case_id(planning.canonical_json(["model", "profile", "prompt", "recipe", "repetition"]))
    return named.groupBy(made.alias("case_id")).agg(F.count("*").alias("n"))


@query(
    MATRIX
    + """
    SELECT model_key, count(*) AS cases, CAST(sum(strlen(rendered_prompt) + 32) AS BIGINT) AS input_tokens,
           CAST(sum(((strlen(rendered_prompt) + 32) * p_size + 400 * 2 * p_size) / 1000000.0) AS DOUBLE) AS cost
    FROM matrix GROUP BY 1
"""
)
def plan_cost(spark, sf_dir):
    """Exact cost ceilings of the plan by model."""
    tokens = planning.token_estimate(F.col("rendered_prompt"))
    cost = planning.cost_estimate(tokens, F.lit(400), F.col("p_size"), F.col("p_size") * 2)
    return (
        _matrix(spark, sf_dir)
        .groupBy("model_key")
        .agg(
            F.count("*").alias("cases"),
            F.sum(tokens).cast("long").alias("input_tokens"),
            F.sum(cost).cast("double").alias("cost"),
        )
    )


@query("""
    SELECT p_partkey, '{json} List ' || p_name || ' {cookbook_title} of ' || p_brand || ' {' || p_name || ' {cookbook_title}}' AS prompt FROM part
""")
def rendered_prompts(spark, sf_dir):
    """Templates with both fields and doubled braces; values that look like fields stay as they are."""
    value = F.concat(F.col("p_name"), F.lit(" {cookbook_title}"))
    template = F.lit("{{json}} List {recipe_name} of {cookbook_title} {{{recipe_name}}}")
    return read(spark, sf_dir, "part").select("p_partkey", planning.render(template, value, F.col("p_brand")).alias("prompt"))


@query("""
    SELECT p_partkey AS case_id, p_partkey AS recipe_id FROM part
    WHERE p_partkey % 5 <> 0 AND (contains(lower('Make ' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END), lower(p_name))
       OR contains(lower('Make ' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END), lower(p_type)))
""")
def prompt_leaks(spark, sf_dir):
    """Prompts of title-only cases that hold a line of their own recipe's text."""
    parts, i = read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    said = F.when(i == 0, F.upper("p_name")).when(i == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    cases = parts.select(
        F.col("p_partkey").alias("case_id"), F.col("p_partkey").alias("recipe_id"), F.concat(F.lit("Make  "), said).alias("rendered_prompt"),
        F.when(F.col("p_partkey") % 5 != 0, "modern_title_only").otherwise("assisted").alias("context_group"),
    )
    protected = parts.select(F.col("p_partkey").alias("recipe_id"), F.concat_ws("\n", "p_name", F.lit(""), "p_type").alias("reference_text_exact"))
    return planning.leaks(cases, protected)


@query("""
    SELECT p_partkey, tokens, CAST(greatest((tokens * 2 + 400 * 3) / 1000000.0 + uses * 0.01, coalesce(cap, 0) * 1.25) AS DOUBLE) AS cost
    FROM (SELECT *, CAST(strlen(p_name) + 32 + uses * CASE WHEN p_partkey % 3 = 2 THEN p_size ELSE greatest(p_size, 16000) END AS BIGINT) AS tokens
          FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN 0.02 END AS cap, CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 6 END AS uses FROM part))
""")
def search_costs(spark, sf_dir):
    """Tokens and cost ceilings with search: uses to reserve for, the floor of engines that choose, and the cap."""
    cap = F.when(F.col("p_size") % 4 == 0, F.lit("0.02").cast("decimal(12,6)"))
    uses = planning.reserved_uses(F.col("p_size") % 6, cap)
    engine = F.element_at(F.array(F.lit("auto"), F.lit("native"), F.lit("exa")), (F.col("p_partkey") % 3 + 1).cast("int"))
    tokens = planning.token_estimate(F.col("p_name"), uses, F.col("p_size"), engine).cast("long")
    cost = planning.cost_estimate(tokens, F.lit(400), F.lit(2), F.lit(3), uses * F.lit("0.01").cast("decimal(3,2)"), cap)
    return read(spark, sf_dir, "part").select("p_partkey", tokens.alias("tokens"), cost.cast("double").alias("cost"))


def _log(spark, sf_dir, ended):
    """Events as an attempt log: an even id starts an attempt, the odd one after it ends it where ``ended`` says so."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 2 == 0, "attempt_started").when(F.col("event_type") == "error", "attempt_failed").otherwise("attempt_succeeded")
    return e.filter((i % 2 == 0) | ended).select(
        F.lit("run").alias("run_file"), F.lit("run").alias("run_id"), kind.alias("event"), F.col("ts").cast("string").alias("recorded_at"),
        F.floor(i / 2).cast("string").alias("attempt_id"), F.lit(None).cast("string").alias("retry_of_attempt_id"), F.lit(1).alias("attempt_number"),
        F.struct(F.col("user_id").cast("string").alias("case_id")).alias("case"), F.lit(None).cast("string").alias("case_id"),
        F.col("event_type").alias("finish_reason"), F.lit(None).cast("string").alias("provider_actual"), F.col("props").alias("output_text"),
        F.col("value").alias("latency_ms"), F.round("value", 6).cast("string").alias("reported_cost_usd"), F.lit(200).alias("status_code"),
        F.lit(False).alias("transient"), F.lit(False).alias("will_retry"), F.lit(None).cast("string").alias("error_type"), F.try_parse_json("props").alias("raw"),
    )


@query("""
    SELECT CAST(s.attempt AS VARCHAR) AS attempt_id, CAST(s.user_id AS VARCHAR) AS case_id, t.outcome AS finish_reason, CAST(round(t.value, 6) AS DOUBLE) AS value
    FROM (SELECT event_id // 2 AS attempt, user_id FROM events WHERE event_id % 2 = 0) s
    LEFT JOIN (SELECT event_id // 2 AS attempt, event_type AS outcome, value FROM events WHERE event_id % 2 = 1 AND event_id % 3 <> 0) t USING (attempt)
""")
def attempt_join(spark, sf_dir):
    """Starts with their ends; some are still open."""
    joined = ev.attempts(_log(spark, sf_dir, F.col("event_id") % 3 != 0))
    return joined.select("attempt_id", "case_id", "finish_reason", F.round("latency_ms", 6).alias("value"))


@query("""
    SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS attempt_number, lag(event_id) OVER w AS retry_of,
           CAST(2.0 ** (row_number() OVER w - 1) AS DOUBLE) AS backoff_s
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""")
def retry_lineage(spark, sf_dir):
    """Attempt numbers, predecessors and waits of repeated attempts."""
    e = read(spark, sf_dir, "events").withColumn("case", F.concat_ws("|", "user_id", "event_type"))
    return ev.with_retries(e, "case", ["ts", "event_id"], "event_id").select("event_id", "attempt_number", "retry_of", "backoff_s")


@query("""
    SELECT user_id, count(*) FILTER (overs = 0) AS dispatched, count(*) AS attempts, CAST(sum(cost) FILTER (overs = 0) AS DOUBLE) AS spent
    FROM (SELECT *, sum(CASE WHEN spent + 2 > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS overs
          FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
                FROM (SELECT user_id, ts, event_id, CAST(round(abs(value), 4) AS DECIMAL(18,4)) AS cost FROM events)))
    GROUP BY 1
""")
def budget_stop(spark, sf_dir):
    """What each user's budget lets through, up to the first attempt that won't fit."""
    e = read(spark, sf_dir, "events").withColumn("cost", F.round(F.abs("value"), 4).cast("decimal(18,4)"))
    rows = ev.budget_stop(e, "user_id", ["ts", "event_id"], "cost", F.lit(2), F.lit(100))
    return rows.groupBy("user_id").agg(
        F.count_if("dispatched").alias("dispatched"),
        F.count("*").alias("attempts"),
        F.sum(F.when(F.col("dispatched"), F.col("cost"))).cast("double").alias("spent"),
    )


@query("""
    WITH firsts AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2)
    SELECT c.user_id, t.event_type, e.event_id,
           CASE WHEN e.event_id IS NULL THEN 'missing' WHEN e.event_id % 5 = 0 THEN 'operational_failure'
                WHEN e.event_id % 7 = 0 THEN 'ineligible_finish_reason' WHEN e.event_id % 11 = 0 THEN 'provider_mismatch'
                WHEN e.event_id % 13 = 0 THEN 'provider_policy_mismatch' WHEN e.event_id % 17 = 0 THEN 'parameter_mismatch' ELSE 'eligible' END AS state
    FROM (SELECT DISTINCT user_id FROM events) c CROSS JOIN (SELECT DISTINCT event_type FROM events) t
    LEFT JOIN firsts e ON e.user_id = c.user_id AND e.event_type = t.event_type
""")
def baseline_match(spark, sf_dir):
    """Requested baselines against what ran, with the first reason against each."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    user, policy = F.col("user_id").cast("string"), "struct<zdr: boolean>"
    plan = [F.lit("plain").alias("prompt_id"), F.lit("1").alias("prompt_version")]
    wanted = [F.lit("maker").alias("provider"), F.struct(F.lit(True).alias("zdr")).cast(policy).alias("policy"), F.struct(F.lit(0).alias("seed")).alias("parameters")]
    types = F.broadcast(e.select(F.col("event_type").alias("model_id")).distinct())
    requested = e.select(user.alias("recipe_id")).distinct().crossJoin(types).select("*", *plan, *wanted)
    ran = e.filter("user_id % 3 <> 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    ran = ran.select(
        i.alias("attempt_id"), F.when(i % 5 != 0, "attempt_succeeded").otherwise("attempt_failed").alias("event"),
        F.when(i % 7 != 0, "stop").otherwise("length").alias("finish_reason"), F.when(i % 11 != 0, "Maker").alias("provider_actual"),
        F.struct(
            user.alias("recipe_id"), F.col("event_type").alias("model_requested"), F.lit("plain").alias("prompt_template_id"),
            F.lit("1").alias("prompt_template_version"), F.struct((i % 13 != 0).alias("zdr")).cast(policy).alias("provider_policy"),
            F.struct(F.when(i % 17 != 0, 0).otherwise(1).alias("seed")).alias("parameters"),
        ).alias("case"),
    )
    found = ev.match_baseline(requested, ran)
    return found.select(F.col("recipe_id").cast("long").alias("user_id"), F.col("model_id").alias("event_type"), F.col("attempt_id").alias("event_id"), "state")


@query("""
    SELECT count(*) FILTER (said AND good) AS true_positives, count(*) FILTER (said AND NOT good) AS false_positives, count(*) FILTER (NOT said AND good) AS false_negatives,
           count(*) FILTER (said AND good) / count(*) FILTER (said)::DOUBLE AS precision, count(*) FILTER (said AND good) / count(*) FILTER (good)::DOUBLE AS recall
    FROM (SELECT quality = 1 AS good, n_chars > 800 AS said FROM labels JOIN documents USING (doc_id))
""")
def classifier_prf(spark, sf_dir):
    """Precision and recall of a length rule against the quality labels."""
    df = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    good, said = F.col("quality") == 1, F.col("n_chars") > 800
    sums = df.agg(
        F.count_if(said & good).alias("true_positives"), F.count_if(said & ~good).alias("false_positives"), F.count_if(~said & good).alias("false_negatives")
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return sums.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})


@query()
def likeness(spark, sf_dir):
    """Sequence ratio, subsequence ratio and ingredient similarity of part names of one brand and size."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    # Pairs of names are fewer than pairs of parts: Python scores each of them once.
    names = p.select("p_name", "p_brand", "p_size").distinct()
    others = names.withColumnRenamed("p_name", "name2")
    pairs = names.join(others, ["p_brand", "p_size"]).select("p_name", "name2").distinct()
    scored = written(_likenesses(pairs.repartition(_tasks(spark), "p_name", "name2")), "likeness")
    # A small table makes many pairs: tasks are dealt by number, and a large group's right side in blocks.
    group = Window.partitionBy("p_brand", "p_size")
    p = p.withColumn("_blocks", F.ceil(F.count("*").over(group) / 4096).cast("int"))
    left = p.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    q = p.select(
        F.col("p_partkey").alias("other"), F.col("p_name").alias("name2"), "p_brand", "p_size",
        F.pmod(F.xxhash64("p_partkey"), F.col("_blocks")).cast("int").alias("_block"),
    )
    keys = ["p_brand", "p_size", "_block"]
    both = left.repartition(_tasks(spark), *keys).join(q.repartition(_tasks(spark), *keys), keys).filter("p_partkey < other")
    return joined(both, ["p_name", "name2"], scored).select("p_partkey", "other", "sequence_ratio", "lcs_ratio", "similarity")


def _tasks(spark) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _likenesses(pairs):
    """Rows of p_name and name2 with their scores."""
    a, b = F.col("p_name"), F.col("name2")
    return pairs.select(
        "p_name",
        "name2",
        text.sequence_ratio(a, b).alias("sequence_ratio"),
        text.lcs_ratio(text.tokens(a), text.tokens(b)).alias("lcs_ratio"),
        text.ingredient_similarity(text.ingredient_key(a), text.ingredient_key(b)).alias("similarity"),
    )


@query()
def full_match(spark, sf_dir):
    """The whole matcher over orders' part names; some answers are misspelled, doubled or out of order."""
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), text.ingredient_key(F.col("p_name")).alias("name"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(names, "l_partkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = lines.withColumn("position", nth)
    none = F.lit(None).cast("string")
    r = F.struct(
        "position", F.col("name").alias("ingredient_text"), F.col("name").alias("key"), F.array("name").alias("variants"), F.array("name").alias("identity_variants"), none.alias("qualifier"),
    )
    spelled = F.when(F.col("position") % 4 == 0, F.concat(F.col("name"), F.lit("x"))).otherwise(F.col("name"))
    c = F.struct(
        (F.col("position") - 1).alias("index"), spelled.alias("raw"), spelled.alias("normalized_key"), spelled.alias("identity_key"), none.alias("ambiguous_reason"), none.alias("qualifier"),
    )
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(r)).alias("references"), F.array_sort(F.collect_list(c)).alias("candidates"))
    found = match(lists).select("l_orderkey", F.explode("matches").alias("m"), F.size("reviews").alias("reviews"))
    return found.select("l_orderkey", "m.candidate_index", "m.reference_position", "m.method", F.round("m.score", 6).alias("score"), "reviews")


@query()
def grade_responses(spark, sf_dir):
    """Grading end to end: orders as recipes of synthetic lines, answers with changed quantities and left-out lines."""
    from assayer.operators.grading import grade

    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = lines.join(parts, "l_partkey").withColumn("position", nth)
    amount = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" cups"))
    references = lines.select(
        F.col("l_orderkey").alias("recipe_id"), "position", F.col("p_name").alias("ingredient_key"), F.col("p_name").alias("ingredient_text"),
        amount.alias("quantity_text_exact"), F.when(F.col("p_size") <= 10, "primary").otherwise("secondary").alias("tier"),
        (F.col("p_size") % 7 == 0).alias("optional"), F.lit(False).alias("subrecipe_reference"), F.col("l_returnflag").alias("section"),
    )
    line = F.concat(F.lit("- "), amount, F.lit(" "), F.col("p_name"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n")
    recipes = lines.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(whole.alias("reference_text_exact"))
    said = lines.filter((F.col("l_orderkey") + F.col("position")) % 5 != 0)
    answers = said.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(whole.alias("response_text")).withColumn("attempt_id", F.col("recipe_id"))
    graded = grade(answers, recipes, references)
    return graded.select(
        "attempt_id", "response_class", F.col("identity.strict.f1").alias("strict_f1"), F.col("quantity.exact_rate").alias("exact_rate"),
        F.col("order.pairwise_accuracy").alias("pairwise_accuracy"), F.size("reviews").alias("reviews"),
    )
