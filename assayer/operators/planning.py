"""Experiment matrices: cases, prompts, leakage, ids and cost ceilings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.text import BREAK, collapse, leakage_form

#: Tokens added to a prompt's bytes, and the least tokens that a use of search is taken to read.
OVERHEAD, SEARCH_FLOOR = 32, 16_000
DRIFT = 1.25


def reserved_uses(most_uses: Column, most_cost: Column) -> Column:
    """Uses of search to reserve for: one where their cost has a cap, else as many as are allowed."""
    return F.when(most_cost.isNotNull(), F.lit(1)).otherwise(most_uses)


def token_estimate(prompt: Column, searches: Column | None = None, search_tokens: Column | None = None, engine: Column | None = None) -> Column:
    """UTF-8 bytes plus overhead, plus what each use of search may read.

    Engines that choose for themselves (auto, native) are taken to read ``SEARCH_FLOOR`` tokens at least.
    """
    base = F.octet_length(prompt) + OVERHEAD
    if searches is None:
        return base
    each = F.coalesce(search_tokens if search_tokens is not None else F.lit(0), F.lit(0))
    floor = F.lit(True) if engine is None else engine.isin("auto", "native")
    return base + searches * F.when(floor, F.greatest(each, F.lit(SEARCH_FLOOR))).otherwise(each)


def money(c: Column) -> Column:
    return c.cast("decimal(12,6)")


def cost_estimate(
    tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, extra: Column | None = None, cap: Column | None = None
) -> Column:
    """Exact cost in the currency of prices for a million tokens; a cap on search may be overrun by a quarter."""
    whole = lambda c: c.cast("decimal(12,0)")
    used = whole(tokens_in) * money(price_in) + whole(tokens_out) * money(price_out)
    cost = (used * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,12)")
    if extra is not None:
        cost = cost + F.coalesce(money(extra), F.lit(0).cast("decimal(12,6)"))
    return cost if cap is None else F.greatest(cost, (money(cap) * F.lit("1.25").cast("decimal(3,2)")).cast("decimal(38,12)"))


def render(template: Column, recipe_name: Column, cookbook_title: Column) -> Column:
    """The two fields of a prompt template filled in, and doubled braces made single. Values are taken as they are."""
    opened, closed, recipe, title = "\ue000\ue001\ue002\ue003"
    marked = F.replace(template, F.lit("{{"), F.lit(opened))
    marked = F.replace(marked, F.lit("{recipe_name}"), F.lit(recipe))
    marked = F.replace(F.replace(marked, F.lit("{cookbook_title}"), F.lit(title)), F.lit("}}"), F.lit(closed))
    plain = F.translate(marked, opened + closed, "{}")
    return _filled(plain, recipe, recipe_name, title, cookbook_title)


def _filled(plain: Column, recipe: str, recipe_name: Column, title: str, cookbook_title: Column) -> Column:
    """Pieces between marks put together by values, which are not searched for marks."""

    def joined(parts: Column, value: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(value, p))
        return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))

    return joined(F.transform(F.split(plain, recipe), lambda p: joined(F.split(p, title), cookbook_title)), recipe_name)


def expand(recipes: DataFrame, prompts: DataFrame, models: DataFrame, profiles: DataFrame, repetitions: int) -> DataFrame:
    """Every case in the order of the configuration.

    The four inputs are configuration, so their product is as large as the plan is; each has a column ``ordinal``,
    and prompts may pin a profile by ``tool_profile``. ``case_ordinal`` columns give the order.
    """
    named = lambda df, name: df.withColumnRenamed("ordinal", f"{name}_ordinal")
    pinned = named(prompts, "prompt").join(
        F.broadcast(named(profiles, "profile")), F.col("tool_profile").isNull() | (F.col("tool_profile") == F.col("tool_profile_id"))
    )
    return (
        named(recipes, "recipe")
        .crossJoin(F.broadcast(pinned))
        .crossJoin(F.broadcast(named(models, "model")))
        .withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    )


def complete_only(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipes to plan and those left out because their reference is incomplete."""
    complete = F.coalesce("reference_complete", F.lit(False))
    return recipes.filter(complete), recipes.filter(~complete)


def canonical_json(fields: list[str]) -> Column:
    """A case's identity as JSON with sorted keys and without what is unset.

    Doubles and control characters are written as Spark writes them; ``canonical_json_exact`` writes them as
    Python does, which ids from elsewhere may depend on.
    """
    return F.to_json(F.struct(*sorted(fields)))


def canonical_json_exact(fields: list[str]) -> Column:
    @F.udf(T.StringType(), useArrow=True)
    def exact(text: str) -> str:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return exact(canonical_json(fields))


def case_id(canonical: Column) -> Column:
    return F.concat(F.lit("case_"), F.sha2(canonical, 256))


def leaks(cases: DataFrame, protected: DataFrame) -> DataFrame:
    """(case_id, recipe_id): prompts of title-only cases that contain their own recipe's text or one of its lines.

    protected: recipe_id, reference_text_exact. Short lines block too; that is the safe side.
    """
    whole = F.col("reference_text_exact")
    parts = F.array_distinct(F.transform(F.array_prepend(F.split(whole, BREAK), whole), collapse))
    lines = protected.select("recipe_id", F.explode(parts).alias("_part")).select("recipe_id", leakage_form(F.col("_part")).alias("_part"))
    own = cases.filter("context_group = 'modern_title_only'").select("case_id", "recipe_id", leakage_form(F.col("rendered_prompt")).alias("_prompt"))
    met = own.join(lines.filter("_part <> ''"), "recipe_id")
    return met.filter(F.contains("_prompt", "_part")).select("case_id", "recipe_id").distinct()


def plan_totals(cases: DataFrame, retries: int) -> DataFrame:
    """Cases, attempts at most, tokens and cost, with and without retries."""
    return cases.agg(
        F.count("*").alias("cases"),
        (F.count("*") * (retries + 1)).alias("most_attempts"),
        F.sum("estimated_input_tokens").alias("input_tokens"),
        F.sum("estimated_output_tokens").alias("output_tokens"),
        F.sum("estimated_cost_usd").alias("cost"),
        (F.sum("estimated_cost_usd") * (retries + 1)).alias("cost_with_retries"),
    )


def preflight(models: DataFrame, catalog: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(model_id, problem) of models that can't run as configured.

    models: model_id, provider, max_input_price, max_output_price, required_parameters. catalog: model_id.
    endpoints: model_id, provider_name, status, input_price, output_price (for a million tokens, as text),
    supported_parameters. Prices that are no number or negative count as missing.
    """
    price = lambda c: F.when(c.try_cast("decimal(18,9)") >= 0, c.try_cast("decimal(18,9)"))
    up = endpoints.filter("status = 0").select(
        "model_id", F.lower("provider_name").alias("_p"), price(F.col("input_price")).alias("_in"), price(F.col("output_price")).alias("_out"), "supported_parameters"
    )
    joined = (
        models.join(catalog.select("model_id", F.lit(True).alias("_listed")), "model_id", "left")
        .withColumn("_p", F.lower("provider"))
        .join(up, ["model_id", "_p"], "left")
    )
    problem = (
        F.when(F.col("_listed").isNull(), "model not in catalog")
        .when(F.col("supported_parameters").isNull(), "provider not available")
        .when(F.col("_in").isNull() | F.col("_out").isNull(), "price not known")
        .when((F.col("_in") > F.col("max_input_price")) | (F.col("_out") > F.col("max_output_price")), "price above ceiling")
        .when(F.size(F.array_except("required_parameters", "supported_parameters")) > 0, "parameter not supported")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("model_id", "problem")
