"""Traces to an evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics
from ..operators.relational import left_lookup
from . import providers as pv


def scene_pairs(slang: DataFrame, neutral: DataFrame) -> DataFrame:
    """trace, scene_id, neutral, slang, events: each slang scene with the last neutral scene of its id.

    A scene without events of its own, or with none in them, takes the neutral one's.
    """
    build = neutral.select(F.concat_ws("|", "trace", "scene_id").alias("_k"), F.col("dialogue").alias("neutral"), F.col("events").alias("_ne"), F.col("idx").alias("_i"))
    rows = left_lookup(slang.withColumn("_k", F.concat_ws("|", "trace", "scene_id")), build, "_k", "_i")
    some = F.size(F.coalesce(F.col("events.key_events"), F.array().cast("array<string>"))) > 0
    return rows.select("trace", "scene_id", F.coalesce("neutral", F.lit("")).alias("neutral"), F.col("dialogue").alias("slang"), F.when(some, F.col("events")).otherwise(F.coalesce("_ne", "events")).alias("events"))


def evaluate(pairs: DataFrame, phrases: DataFrame, singles: DataFrame, similarity: Column, judged: DataFrame | None = None) -> dict[str, DataFrame]:
    """scenes with all metrics, the script's rollup, its top slang and the report."""
    rows = metrics.scene_metrics(metrics.detect_slang(pairs, phrases, singles))
    rows = rows.withColumn("similarity", similarity).withColumn("recall", metrics.covered_events("slang", F.col("events.key_events"))["recall"])
    scenes = metrics.validate(rows)
    return {"scenes": scenes, "rollup": metrics.script_rollup(scenes), "top_slang": metrics.top_slang(scenes), "report": metrics.report(scenes, judged)}


def baseline(lines: DataFrame, romanizer: pv.Provider, text: str = "text") -> DataFrame:
    """Non-blank lines with roman and failed: a line without an answer is an empty line and counts as a failure."""
    rows = lines.withColumn(text, tx.strip(F.coalesce(text, F.lit("")))).filter(F.col(text) != "")
    rows = pv.per_distinct(rows, F.col(text), romanizer)
    return rows.withColumn("roman", F.coalesce("response", F.lit(""))).withColumn("failed", F.col("response").isNull()).drop("prompt_key", "response")


def baseline_counts(done: DataFrame) -> DataFrame:
    """One row: processed and failures."""
    return done.agg(F.count("*").alias("processed"), F.count_if("failed").alias("failures"))
