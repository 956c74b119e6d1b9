"""The attempt log as a stream: parsing, attempt states, running budgets, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.events import SCHEMA

STATE = "spent double, stopped boolean"
LEDGER = "run_id string, attempt_id string, cost double, spent_before double, dispatched boolean"


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of JSON-line files as they appear; lines that are no JSON object have a null event."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(path)
    return lines.select(F.from_json("value", SCHEMA).alias("e")).select("e.*").withColumn("at", F.to_timestamp("recorded_at"))


def outcome_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ended attempts and their cost by model and time window; rows later than ``late`` are dropped."""
    ended = events.filter(F.col("event").isin("attempt_succeeded", "attempt_failed"))
    return (
        ended.withWatermark("at", late)
        .groupBy(F.window("at", width), "event")
        .agg(F.count("*").alias("attempts"), F.sum(F.col("reported_cost_usd").try_cast("double")).alias("cost"))
    )


def budget_ledger(events: DataFrame, budget: float, reservation: float) -> DataFrame:
    """Each run's ended attempts with what was spent before them; none is dispatched after the first that won't fit.

    State is two values for each run. A run's events must come in order, one run to one key.
    """

    def each(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent, stopped = state.get if state.exists else (0.0, False)
        for frame in frames:
            out = []
            for r in frame.sort_values("recorded_at", kind="stable").itertuples():
                stopped = stopped or spent + reservation > budget
                cost = 0.0 if r.cost is None or r.cost != r.cost else float(r.cost)
                out.append((key[0], r.attempt_id, cost, spent, not stopped))
                spent += 0.0 if stopped else cost
            yield pd.DataFrame(out, columns=["run_id", "attempt_id", "cost", "spent_before", "dispatched"])
        state.update((spent, stopped))

    ended = events.filter(F.col("event").isin("attempt_succeeded", "attempt_failed")).select(
        "run_id", "attempt_id", "recorded_at", F.col("reported_cost_usd").try_cast("double").alias("cost")
    )
    return ended.groupBy("run_id").applyInPandasWithState(each, LEDGER, STATE, "append", "NoTimeout")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A durable JSON-lines sink; every row is written exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
