"""Stories to scenes, scenes to lines, and back to a screenplay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.transliterate import transliterate

FIRST_SCENE = "This is the first scene."


def scene_id(idx: str = "scene_idx") -> Column:
    return F.format_string("scene_%02d", F.col(idx))


def scene_chunks(stories: DataFrame, delimiter: str = "\n\n", locations=lx.LOCATION_CUES, times=lx.TEMPORAL_CUES, whole_word: bool = False) -> DataFrame:
    """story_id, scene_idx (from 1), scene_id, text and cue flags of every non-blank paragraph."""
    parts = F.filter(F.transform(F.split(F.col("text"), delimiter), tx.strip), lambda p: p != "")
    rows = stories.select("story_id", F.posexplode(parts).alias("i", "text"))
    rows = rows.withColumn("scene_idx", F.col("i") + 1)
    return rows.select(
        "story_id", "scene_idx", scene_id().alias("scene_id"), "text",
        tx.has_cue("text", locations, whole_word).alias("has_location_cue"), tx.has_cue("text", times, whole_word).alias("has_temporal_cue"),
    )


def romanized_chunks(stories: DataFrame) -> DataFrame:
    """Scenes of Devanagari stories, romanized; paragraphs that romanize to nothing are no scenes."""
    parts = F.filter(F.transform(F.split(F.col("text"), "\n\n"), tx.strip), lambda p: p != "")
    rows = stories.select("story_id", F.posexplode(parts).alias("i", "raw")).withColumn("text", transliterate("raw")).filter("text <> ''")
    rows = rows.withColumn("scene_idx", F.row_number().over(W.partitionBy("story_id").orderBy("i")))
    return rows.select(
        "story_id", "scene_idx", scene_id().alias("scene_id"), "text",
        tx.has_cue("text", lx.LOCATION_CUES).alias("has_location_cue"), tx.has_cue("text", lx.TEMPORAL_CUES).alias("has_temporal_cue"),
    )


def dialogue_lines(scenes: DataFrame, keys: list[str], dialogue: str = "dialogue") -> DataFrame:
    """One row per line of a dialogue; lines with a speaker but nothing said go."""
    rows = scenes.select(*keys, F.posexplode(F.split(F.coalesce(F.col(dialogue), F.lit("")), "\n")).alias("line_idx", "line"))
    rows = rows.filter(tx.strip("line") != "").withColumn("d", tx.dialogue_line("line"))
    return rows.select(*keys, "line_idx", "line", "d.speaker", "d.utterance", "d.is_dialogue").filter("not is_dialogue or utterance <> ''")


def previous_goal(scenes: DataFrame, goal: str = "scene_goal", keys: list[str] | None = None, order: str = "scene_idx") -> DataFrame:
    """The goal of the scene before; the first scene has a fixed sentence."""
    w = W.partitionBy(*(keys or ["story_id"])).orderBy(order)
    return scenes.withColumn("previous_goal", F.coalesce(F.lag(goal).over(w), F.when(F.row_number().over(w) == 1, F.lit(FIRST_SCENE))))


def screenplay(scenes: DataFrame, keys: list[str], order: str, title: str, body: str) -> DataFrame:
    """All scenes of a story as one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("## "), F.col(title), F.lit("\n"), F.coalesce(F.col(body), F.lit(""))).alias("t"))))
    return scenes.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("script"))
