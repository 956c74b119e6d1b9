"""The append-only log of attempts: reading, pairing, retries, budgets and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.planning import DRIFT

TRANSIENT = [408, 409, 429, 500, 502, 503, 504]
TERMINAL = ["attempt_succeeded", "attempt_failed"]
SCHEMA = """
    event string, recorded_at string, run_id string, attempt_id string, retry_of_attempt_id string, attempt_number int,
    case struct<case_id: string, recipe_id: string, model_requested: string, prompt_template_id: string,
        prompt_template_version: string, provider_policy: struct<allow_fallbacks: boolean, data_collection: string,
        only: array<string>, zdr: boolean>, parameters: struct<max_tokens: int, seed: int, temperature: double>>,
    case_id string, provider_actual string, finish_reason string, output_text string, latency_ms double,
    reported_cost_usd string, error_type string, error string, status_code int, transient boolean, will_retry boolean
"""


def read_events(spark: SparkSession, paths: str | list[str], *, strict: bool = True) -> DataFrame:
    """Event rows with run_file and the raw line as a variant.

    A line that is no JSON object fails the query when it runs (strict), or is left out.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("run_file"), F.trim("value").alias("line")).filter("line <> ''")
    return _parsed(lines, strict)


def _parsed(lines: DataFrame, strict: bool) -> DataFrame:
    raw = F.try_parse_json("line")
    sound = F.coalesce(F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")), F.lit(False))
    if strict:
        bad = F.raise_error(F.concat(F.lit("malformed event in "), F.col("run_file")))
        lines = lines.withColumn("line", F.when(sound, F.col("line")).otherwise(bad.cast("string")))
    else:
        lines = lines.filter(sound)
    rows = lines.select("run_file", F.try_parse_json("line").alias("raw"), F.from_json("line", SCHEMA).alias("e"))
    return rows.select("run_file", "raw", "e.*")


def attempts(events: DataFrame) -> DataFrame:
    """Started attempts with their end, joined within a run file; the end's columns are null while it is open."""
    started = events.filter("event = 'attempt_started'").select(
        "run_file", "run_id", "attempt_id", "retry_of_attempt_id", "attempt_number", F.coalesce("case.case_id", "case_id").alias("case_id"), "case",
        F.col("recorded_at").alias("started_at"),
    )
    ended = events.filter(F.col("event").isin(*TERMINAL)).select(
        "run_file", "attempt_id", "event", "finish_reason", "provider_actual", "output_text", "latency_ms", "reported_cost_usd",
        "status_code", "transient", "will_retry", "error_type", "raw", F.col("recorded_at").alias("ended_at"),
    )
    return started.join(ended, ["run_file", "attempt_id"], "left")


def unstarted(events: DataFrame) -> DataFrame:
    """Ends of attempts that never started in their run file."""
    started = events.filter("event = 'attempt_started'").select("run_file", "attempt_id")
    return events.filter(F.col("event").isin(*TERMINAL)).join(started, ["run_file", "attempt_id"], "left_anti")


def open_runs(events: DataFrame) -> DataFrame:
    """Runs that don't have exactly one completion."""
    return events.groupBy("run_file").agg(F.count_if(F.col("event") == "run_completed").alias("completions")).filter("completions <> 1")


def is_transient(status: Column, transport_error: Column) -> Column:
    return F.coalesce(status.isin(*TRANSIENT), F.lit(False)) | F.coalesce(transport_error, F.lit(False))


def output_text(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows with output: the text of whichever of an event's two shapes it has; both or neither fails the query."""
    direct = F.try_variant_get(raw, "$.output_text", "string")
    nested = F.try_variant_get(raw, "$.raw_response.choices[0].message.content", "string")
    wrong = F.raise_error(F.lit("an event must have one output")).cast("string")
    return rows.withColumn("output", F.when(direct.isNull() == nested.isNull(), wrong).otherwise(F.coalesce(direct, nested)))


def with_generation(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attempts with generation metadata by generation_id; its error, or absence, is a value and not a failure.

    metadata: generation_id, provider_name, metadata_error. The provider of the metadata goes before the response's.
    """
    joined = rows.join(metadata, "generation_id", "left")
    missing = F.when(F.col("generation_id").isNotNull() & F.col("provider_name").isNull() & F.col("metadata_error").isNull(), "no metadata")
    return joined.withColumns(
        {"provider_actual": F.coalesce("provider_name", "provider_actual"), "metadata_error": F.coalesce("metadata_error", missing)}
    )


def with_retries(rows: DataFrame, case: str, order: list[str], attempt: str) -> DataFrame:
    """attempt_number, retry_of and backoff_s (2^(n-1) after attempt n) of each case's attempts."""
    over = Window.partitionBy(case).orderBy(*order)
    n = F.row_number().over(over)
    return rows.withColumns({"attempt_number": n, "retry_of": F.lag(attempt).over(over), "backoff_s": F.pow(F.lit(2.0), n - 1)})


def reported_cost(usage: Column) -> Column:
    """The first usable of cost and total_cost in a usage object, or the object itself as a number."""
    number = lambda path: F.when(
        ~F.coalesce(F.schema_of_variant(F.try_variant_get(usage, path, "variant")) == "BOOLEAN", F.lit(False)),
        F.try_variant_get(usage, path, "decimal(18,9)"),
    )
    return F.coalesce(number("$.cost"), number("$.total_cost"), number("$"))


def budget_stop(rows: DataFrame, run: str, order: list[str], cost: str, reservation: Column, budget: Column) -> DataFrame:
    """Each run's attempts in order with what was spent before; ``dispatched`` ends at the first that won't fit.

    Spending comes only from dispatched attempts, and none follows the first overflow, so a plain running sum says
    all: what it holds after the stop isn't used.
    """
    over = Window.partitionBy(run).orderBy(*order)
    before = F.coalesce(F.sum(cost).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("spent_before", before)
    overflow = (F.col("spent_before") + reservation > budget).cast("int")
    stopped = F.max("_over").over(over.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_over", overflow).withColumn("dispatched", stopped == 0).drop("_over")


def drifted(rows: DataFrame, actual: str, estimate: str) -> DataFrame:
    """Attempts that cost more than a quarter over their estimate."""
    return rows.filter(F.col(actual) > F.col(estimate) * F.lit(DRIFT).cast("decimal(3,2)"))


def run_summary(rows: DataFrame) -> DataFrame:
    """Attempts, successes, failures and cost of each run file; failures' costs count."""
    success = (F.col("event") == "attempt_succeeded") & ~F.col("finish_reason").eqNullSafe(F.lit("tool_calls"))
    return rows.groupBy("run_file").agg(
        F.count("*").alias("attempts"),
        F.count_if(success).alias("succeeded"),
        F.count_if(F.col("event").isNotNull() & ~success).alias("failed"),
        F.sum(F.col("reported_cost_usd").try_cast("decimal(18,9)")).alias("cost"),
    )


def eligibility(event: Column, finish: Column, provider: Column, wanted: Column, same_policy: Column, same_parameters: Column) -> Column:
    """Whether an attempt can stand as a baseline; the first reason against it."""
    return (
        F.when(~event.eqNullSafe(F.lit("attempt_succeeded")), "operational_failure")
        .when(~finish.eqNullSafe(F.lit("stop")), "ineligible_finish_reason")
        .when(~F.lower(provider).eqNullSafe(F.lower(wanted)), "provider_mismatch")
        .when(~same_policy, "provider_policy_mismatch")
        .when(~same_parameters, "parameter_mismatch")
        .otherwise("eligible")
    )


def match_baseline(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """Requested (recipe_id, model_id, prompt_id, prompt_version, provider, policy, parameters) against attempts.

    Adds attempt_id, starts and state: missing without a start, else ``eligibility``. More than one start, or an
    open attempt, fails the query when it runs. Policies and parameters are compared as typed structs.
    """
    found = rows.select(
        "attempt_id", "event", "finish_reason", "provider_actual",
        F.col("case.recipe_id").alias("recipe_id"), F.col("case.model_requested").alias("model_id"),
        F.col("case.prompt_template_id").alias("prompt_id"), F.col("case.prompt_template_version").alias("prompt_version"),
        F.col("case.provider_policy").alias("_policy"), F.col("case.parameters").alias("_parameters"),
    )
    key = ["recipe_id", "model_id", "prompt_id", "prompt_version"]
    joined = requested.join(found, key, "left").withColumn("starts", F.count("attempt_id").over(Window.partitionBy(*key)))
    several = F.raise_error(F.lit("a baseline case was started more than once")).cast("string")
    pending = F.raise_error(F.lit("a baseline attempt has no end")).cast("string")
    state = (
        F.when(F.col("attempt_id").isNull(), "missing")
        .when(F.col("starts") > 1, several)
        .when(F.col("event").isNull(), pending)
        .otherwise(
            eligibility(
                F.col("event"), F.col("finish_reason"), F.col("provider_actual"), F.col("provider"),
                F.col("policy").eqNullSafe(F.col("_policy")), F.col("parameters").eqNullSafe(F.col("_parameters")),
            )
        )
    )
    return joined.withColumn("state", state).drop("_policy", "_parameters")
