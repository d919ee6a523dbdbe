"""Characters: who appears first where, their role, mood and stress over scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from .relational import keep_first

#: Steps that are folded into one clamp before the clamps of a character are folded.
CHUNK = 4096


def social_role(c: str | Column, keywords: dict[str, list[str]] = lx.ROLE_KEYWORDS, whole_word: bool = False) -> Column:
    """The first role any of whose keywords stands in the text, else ``peer``."""
    out = F.lit("peer")
    for role, found in reversed(list(keywords.items())):
        out = F.when(tx.has_cue(c, found, whole_word), F.lit(role)).otherwise(out)
    return out


def slang_level(role: str | Column) -> Column:
    return F.when(tx.col(role).isin("elder", "authority"), F.lit(0)).otherwise(F.lit(5))


def names_of(scenes: DataFrame, story: str = "story_id", idx: str = "scene_idx", agent: str = "characters", found: str | None = None) -> DataFrame:
    """One row per scene and name: the scene's names, then recognised ones not among them, whatever their case; no known non-characters."""
    names = F.coalesce(F.col(agent), F.array().cast("array<string>"))
    if found:
        names = F.concat(names, F.coalesce(F.col(found), F.array().cast("array<string>")))
    rows = scenes.select(story, idx, F.posexplode(tx.keep_first_ignoring_case(names)).alias("pos", "name"))
    return rows.filter((tx.strip("name") != "") & ~F.lower("name").isin(lx.NON_CHARACTERS))


def first_profiles(names: DataFrame, story: str = "story_id", order: tuple[str, ...] = ("scene_idx", "pos")) -> DataFrame:
    """Each character's row of the scene it is first seen in, whatever the name's case."""
    return keep_first(names.withColumn("_low", F.lower("name")), [story, "_low"], list(order)).drop("_low")


def new_profiles(names: DataFrame, context: str) -> DataFrame:
    """Profiles with the role that the whole scene suggests and everything else at rest."""
    role = social_role(context)
    return names.select(
        "*", F.lit(None).cast("int").alias("age"), role.alias("social_role"), slang_level(role).alias("slang_level"),
        F.lit("neutral").alias("current_emotion"), F.lit(0).alias("turn_count"), F.lit(0.0).alias("stress_index"),
    )


def merged_map(rows: DataFrame, keys: list[str], key: str, value: str, order: str) -> DataFrame:
    """A map per group in which the latest value of a key wins."""
    one = rows.groupBy(*keys, key).agg(F.max_by(value, order).alias("_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_v"))))).alias("merged"))


def triggered_emotion(c: str | Column, triggers: dict[str, list[str]] = lx.EMOTION_TRIGGERS) -> Column:
    """The first emotion with a trigger in the text; null if none has."""
    out = F.lit(None).cast("string")
    for emotion, found in reversed(list(triggers.items())):
        out = F.when(tx.has_cue(c, found), F.lit(emotion)).otherwise(out)
    return out


def emotion_track(rows: DataFrame, keys: list[str], order: list[str], trigger: str) -> DataFrame:
    """Adds the emotion held after each row, the turn, and the stress it adds in tenths."""
    w = W.partitionBy(*keys).orderBy(*order)
    held = F.coalesce(F.last(trigger, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit("neutral"))
    steps = F.create_map(*[F.lit(x) for kv in lx.STRESS_TENTHS.items() for x in kv])
    rows = rows.withColumn("emotion", held).withColumn("turn", F.row_number().over(w))
    return rows.withColumn("step", F.coalesce(F.try_element_at(steps, F.col("emotion")), F.lit(0)))


def clamp(lo: Column, hi: Column, add: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), add.cast("int").alias("add"))


def after(f: Column, g: Column) -> Column:
    """x -> min(hi, max(lo, x + add)) of f, then that of g, as one such function."""
    at = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["add"]))
    return clamp(at(f["lo"]), at(f["hi"]), f["add"] + g["add"])


def final_states(rows: DataFrame, keys: list[str], order: list[str], trigger: str) -> DataFrame:
    """Emotion, turns and stress of each character after its last row.

    Stress is a sum that is cut off at 0 and 1 after every step. Such steps compose, so a
    character's rows are folded in chunks of a bounded size, then its chunks are.
    """
    track = emotion_track(rows, keys, order, trigger).withColumn("chunk", F.floor((F.col("turn") - 1) / CHUNK))
    start = clamp(F.lit(-(10**8)), F.lit(10**8), F.lit(0))

    def fold(items: Column, step) -> Column:
        return F.aggregate(F.array_sort(items), start, lambda acc, x: after(acc, step(x)))

    steps = F.collect_list(F.struct("turn", "step"))
    one = lambda x: clamp(F.lit(0), F.lit(10), x["step"])
    chunks = track.groupBy(*keys, "chunk").agg(fold(steps, one).alias("f"), F.max_by("emotion", "turn").alias("emotion"), F.max("turn").alias("turns"))
    out = chunks.groupBy(*keys).agg(F.collect_list(F.struct("chunk", "f")).alias("fs"), F.max_by("emotion", "chunk").alias("emotion"), F.max("turns").alias("turn_count"))
    whole = fold(F.col("fs"), lambda x: x["f"])
    stress = F.least(whole["hi"], F.greatest(whole["lo"], whole["add"])) / 10.0
    return out.select(*keys, "emotion", F.col("turn_count").cast("long").alias("turn_count"), F.round(stress, 3).alias("stress_index"))


def with_profile(lines: DataFrame, profiles: DataFrame, on: list[str], speaker: str = "speaker") -> DataFrame:
    """Lines with their speaker's role, level and emotion, whatever the name's case; defaults where it is unknown."""
    p = keep_first(profiles.withColumn("_low", F.lower("name")), [*on, "_low"], ["name"])
    p = p.select(*on, "_low", F.col("social_role").alias("_r"), F.col("slang_level").alias("_l"), F.col("current_emotion").alias("_e"))
    out = lines.withColumn("_low", F.lower(speaker)).join(p, [*on, "_low"], "left").drop("_low")
    out = out.withColumn("social_role", F.coalesce("_r", F.lit("peer"))).withColumn("slang_level", F.coalesce("_l", F.lit(5)))
    return out.withColumn("current_emotion", F.coalesce("_e", F.lit("neutral"))).drop("_r", "_l", "_e")


def persons(c: str | Column) -> Column:
    """A stand-in for person recognition: capitalised words of two letters or more that don't begin a sentence."""
    found = F.regexp_extract_all(tx.col(c), F.lit(r"(?<![.!?।]\s)(?<!^)\b\p{Lu}[\p{L}\p{M}]+"), F.lit(0))
    return F.array_distinct(found)
