"""Sources and sinks. Everything goes through Spark's readers and writers, so any store will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.dataprep import RAW_COLUMNS

TEXT_SUFFIXES = "py md txt json jsonl csv yaml yml toml cfg ini html css js".split()
SKIPPED_FOLDERS = ".git __pycache__ node_modules .venv venv .idea .pytest_cache".split()


def read_stories(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """story_id (the file's path), text: one row per whole file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("story_id"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stripped lines of text files without blank ones."""
    return spark.read.text(path).select(tx.strip("value").alias("line")).filter("line <> ''")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV with a header, quoted fields over several lines, all strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, enforceSchema=False)


def read_raw_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw slang pairs under our names, numbered in file order."""
    rows = read_csv(spark, path, list(RAW_COLUMNS)).withColumnsRenamed(RAW_COLUMNS)
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def read_clean_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Clean or augmented pairs with their lists as arrays."""
    names = ["neutral", "output", "control", "function", "positions", "multi_allowed", "social_context", "context", "slangs", "source"]
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in names])
    parts = lambda c: F.filter(F.transform(F.split(c, r"\|"), tx.strip), lambda x: x != "")
    return rows.withColumn("positions", parts("positions")).withColumn("slangs", parts("slangs")).withColumn("multi_allowed", F.lower("multi_allowed") == "true")


TRACE_SCHEMA = (
    "romanized_text string, event_chain array<struct<scene_id: string, key_events: array<string>, characters: array<string>, scene_goal: string>>, "
    "neutral_script array<struct<scene_id: string, dialogue: string, events: struct<key_events: array<string>>>>, "
    "slang_script array<struct<scene_id: string, dialogue: string, events: struct<key_events: array<string>>>>, final_script string"
)


def read_traces(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Slang scenes and neutral scenes (trace, idx, scene_id, dialogue, events) of JSON traces; a missing script is empty."""
    rows = spark.read.schema(TRACE_SCHEMA).json(path, multiLine=True).withColumn("trace", F.col("_metadata.file_path"))

    def script(name: str) -> DataFrame:
        return rows.select("trace", F.posexplode(name).alias("idx", "s")).select("trace", "idx", "s.*")

    return script("slang_script"), script("neutral_script")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are passed over."""
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.limit(limit)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first rows of any source."""
    return df.limit(n)


def write_screenplay(script: DataFrame, path: str) -> None:
    """One text file row per story."""
    script.select(F.col("script").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; other letters than ASCII as they are."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays joined by bars. Spark's commit makes the folder appear whole."""
    cols = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def write_rejects(parts: list[DataFrame], path: str) -> None:
    """Rejected rows of several kinds, with all their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_csv(out, path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Editor examples: input and target only."""
    write_json(examples.select("input", "target"), path)


def write_lexicon(counts: DataFrame, path: str) -> None:
    """A nested map of counts: key kind, key, slang."""
    per_key = counts.groupBy("key_kind", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slang", "cnt")))).alias("slangs"))
    per_kind = per_key.groupBy("key_kind").agg(F.map_from_entries(F.collect_list(F.struct("key", "slangs"))).alias("keys"))
    write_json(per_kind, path)


def save_state(df: DataFrame, root: str, session: str, key: str) -> None:
    """One table of a session, overwritten as a whole."""
    df.write.mode("overwrite").parquet(f"{root}/session={safe(session)}/{safe(key)}")


def load_state(spark: SparkSession, root: str, session: str, key: str) -> DataFrame | None:
    """A session's table; None if it was never saved."""
    path = f"{root}/session={safe(session)}/{safe(key)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", name)


def resume(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates that earlier output doesn't have."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def pack_folder(spark: SparkSession, path: str, suffixes: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """path, text of the text files below a folder, without skipped folders; files whose start isn't UTF-8 go."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = rows.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(suffixes or TEXT_SUFFIXES))
    rows = rows.filter(~F.exists(F.split("path", "/"), lambda p: p.isin(skip or SKIPPED_FOLDERS)))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("text")).filter("text is not null")
