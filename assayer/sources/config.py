"""Experiment configuration: a YAML file, strictly checked, as small tables."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession

_ID = re.compile(r"[a-z0-9][a-z0-9._/:-]*")
_FIELD = re.compile(r"\{([^{}]*)\}")
TOP = {"schema_version", "experiment_id", "max_budget_usd", "repetitions", "recipes", "prompts", "models"}
PROMPT, MODEL = {"id", "version", "context_group", "template"}, {"id", "routing", "max_output_tokens", "pricing_ceiling"}
FIELDS = {"recipe_name", "cookbook_title"}


def _keys(what: str, given: dict, required: set[str], optional: set[str] = frozenset()) -> None:
    if not isinstance(given, dict):
        raise ValueError(f"{what} must be a mapping")
    if bad := sorted(required - given.keys()):
        raise ValueError(f"{what} lacks {', '.join(bad)}")
    if bad := sorted(given.keys() - required - optional):
        raise ValueError(f"{what} has unknown {', '.join(bad)}")


def _unique(what: str, values: list) -> None:
    if len(values) != len(set(values)):
        raise ValueError(f"{what} repeat")


def _money(what: str, given) -> Decimal:
    try:
        amount = Decimal(str(given))
    except InvalidOperation:
        raise ValueError(f"{what} is no amount") from None
    if isinstance(given, bool) or not amount.is_finite() or amount < 0:
        raise ValueError(f"{what} is no amount")
    return amount


def check(config: dict) -> dict:
    """The configuration with amounts as decimals, or a ValueError that names what is wrong."""
    _keys("configuration", config, TOP, {"tool_profiles", "retries", "concurrency", "description"})
    config = config | {"max_budget_usd": _money("max_budget_usd", config["max_budget_usd"])}
    if isinstance(config["repetitions"], bool) or not isinstance(config["repetitions"], int) or config["repetitions"] < 1:
        raise ValueError("repetitions must be a whole number from 1")
    for name in ("recipes", "prompts", "models"):
        if not isinstance(config[name], list) or not config[name]:
            raise ValueError(f"{name} must be a list with entries")
    _unique("recipes", config["recipes"])
    profiles = config.get("tool_profiles", [])
    _unique("tool profiles", [p["id"] for p in profiles])
    for p in config["prompts"]:
        _keys("prompt", p, PROMPT, {"tool_profile"})
        if bad := sorted(set(_FIELD.findall(p["template"])) - FIELDS):
            raise ValueError(f"template of {p['id']} has unknown field {bad[0]}")
        if p.get("tool_profile") and p["tool_profile"] not in {x["id"] for x in profiles}:
            raise ValueError(f"prompt {p['id']} names an unknown tool profile")
    _unique("prompts", [(p["id"], str(p["version"])) for p in config["prompts"]])
    for m in config["models"]:
        _keys("model", m, MODEL, {"temperature", "seed"})
        if m["max_output_tokens"] < 1:
            raise ValueError(f"max_output_tokens of {m['id']} must be positive")
        for k, v in m["pricing_ceiling"].items():
            _money(f"pricing_ceiling.{k} of {m['id']}", v)
    _unique("models", [m["id"] for m in config["models"]])
    for given in [config["experiment_id"], *(p["id"] for p in config["prompts"])]:
        if not _ID.fullmatch(given):
            raise ValueError(f"bad identifier {given!r}")
    return config


def load(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The checked configuration and its recipes, prompts, models and tool_profiles, each with its ordinal."""
    import yaml

    with open(path, encoding="utf-8") as file:
        config = check(yaml.safe_load(file))
    rows = {
        "recipes": ([(i, r) for i, r in enumerate(config["recipes"])], "ordinal int, recipe_id string"),
        "prompts": (
            [(i, p["id"], str(p["version"]), p["context_group"], p["template"], p.get("tool_profile")) for i, p in enumerate(config["prompts"])],
            "ordinal int, prompt_id string, prompt_version string, context_group string, template string, tool_profile string",
        ),
        "models": (
            [(i, m["id"], m["max_output_tokens"], {k: str(v) for k, v in m["pricing_ceiling"].items()}) for i, m in enumerate(config["models"])],
            "ordinal int, model_id string, max_output_tokens int, pricing_ceiling map<string, string>",
        ),
        "tool_profiles": (
            [(i, p["id"]) for i, p in enumerate(config.get("tool_profiles") or [{"id": "none"}])], "ordinal int, tool_profile_id string",
        ),
    }
    return config, {name: spark.createDataFrame(data, schema) for name, (data, schema) in rows.items()}
