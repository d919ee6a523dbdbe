"""Model steps without a model: a provider adds a nullable ``response`` to rows.

``replay`` looks responses up in a recorded table; ``rule`` computes them with a column
expression, as a stand-in that makes no claim to a model's quality; ``failover`` takes the
first that answers. A null response is a failed call; each step then falls back as noted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators.relational import keep_first

Provider = Callable[[DataFrame], DataFrame]

EVENT_SCHEMA = "scene_id string, key_events array<string>, characters array<string>, scene_goal string, location string, narrative_link string, pronoun_map map<string,string>"


def replay(recorded: DataFrame, key: str = "prompt_key") -> Provider:
    """Responses of a table (key, response); the smallest of several."""
    one = keep_first(recorded.select(key, "response"), [key], ["response"])
    return lambda rows: rows.join(one, key, "left")


def rule(response: Column) -> Provider:
    return lambda rows: rows.withColumn("response", response)


def failover(*providers: Provider) -> Provider:
    """The first non-null response, in order."""

    def run(rows: DataFrame) -> DataFrame:
        out = rows
        for i, p in enumerate(providers):
            out = p(out).withColumnRenamed("response", f"_r{i}")
        names = [f"_r{i}" for i in range(len(providers))]
        return out.withColumn("response", F.coalesce(*names)).drop(*names)

    return run


def per_distinct(rows: DataFrame, key: Column, provider: Provider) -> DataFrame:
    """Asks once for each distinct key and brings responses back to all rows with it."""
    rows = rows.withColumn("prompt_key", key)
    asked = provider(rows.select("prompt_key").distinct())
    return rows.join(asked.select("prompt_key", "response"), "prompt_key", "left")


def classify_intents(lines: DataFrame, provider: Provider, utterance: str = "utterance") -> DataFrame:
    """Adds intent: blank lines inform; failures and unknown labels are casual."""
    rows = per_distinct(lines, F.lower(tx.strip(F.coalesce(utterance, F.lit("")))), provider)
    label = F.when(F.col("prompt_key") == "", "INFORM_NEUTRAL").otherwise(tx.intent_label("response"))
    return rows.withColumn("intent", label).drop("prompt_key", "response")


def keyword_intent(key: str = "prompt_key") -> Column:
    """A rule for intents by marks and mood words."""
    low = F.lower(F.coalesce(F.col(key), F.lit("")))
    mood = {"urgent": "REQUEST_URGENCY", "angry": "ASSERT_FRUSTRATION", "happy": "ASSERT_POSITIVE", "anxious": "EXPRESS_STRESS"}
    out = F.when(F.endswith(low, F.lit("?")), "QUESTION_FORMAL")
    for emotion, intent in mood.items():
        out = out.when(tx.has_cue(low, lx.EMOTION_TRIGGERS[emotion]), intent)
    return out.otherwise("CASUAL_ASSERTION")


def intent_scores(utterance: str) -> Column:
    """Scores of all intents by the rule above; all zero for a blank line."""
    top = keyword_intent(utterance)
    blank = tx.strip(F.coalesce(F.col(utterance), F.lit(""))) == ""
    return F.array(*[F.struct(F.lit(i).alias("label"), F.when(~blank & (top == i), 1.0).otherwise(0.0).alias("score")) for i in lx.INTENTS])


def extract_events(scenes: DataFrame, provider: Provider) -> DataFrame:
    """Exactly one event record per scene, under the scene's own id.

    An array without records gives a record whose link is the previous summary, an
    unreadable reply one without link. A failed call (null) stays null in ``key_events``
    for the caller to raise on.
    """
    rows = provider(scenes.withColumn("prompt_key", F.concat_ws("|", "story_id", "scene_id")))
    parsed = tx.json_objects("response", EVENT_SCHEMA)
    first = F.try_element_at(parsed, F.lit(1))
    empty = F.regexp_replace(F.coalesce("response", F.lit("")), r"[\s`]|json", "") == "[]"
    failed = F.col("response").isNull()
    arr, none = "array<string>", F.array().cast("array<string>")
    return rows.select(
        "story_id", "scene_idx", "scene_id", "text",
        F.when(failed, F.lit(None).cast(arr)).otherwise(F.coalesce(first["key_events"], none)).alias("key_events"),
        F.coalesce(first["characters"], none).alias("characters"), F.coalesce(first["scene_goal"], F.lit("")).alias("scene_goal"),
        F.coalesce(first["location"], F.lit("unknown")).alias("location"),
        F.coalesce(first["narrative_link"], F.when(empty, F.lit("This is the first scene.")).otherwise(F.lit(""))).alias("narrative_link"),
        F.coalesce(first["pronoun_map"], F.create_map().cast("map<string,string>")).alias("pronoun_map"),
    )


def dialogue_of(response: str, speaker: Column, placeholder: Column) -> Column:
    """A reply as dialogue: the speaker is put before lines without a colon; a placeholder stands for a failed call."""
    line = tx.strip(F.coalesce(F.col(response), F.lit("")))
    spoken = F.when(F.contains(line, F.lit(":")), line).otherwise(F.concat(speaker, F.lit(": "), line))
    return F.when(line == "", F.concat(speaker, F.lit(": "), placeholder)).otherwise(spoken)


def edit_lines(lines: DataFrame, provider: Provider, utterance: str = "utterance", intent: str = "intent") -> DataFrame:
    """Adds new: the line as an editor rewrites it under its intent's control.

    The editor is asked once for each distinct request. A filler at both ends is left at
    the front only; a failed or empty reply, or one that differs in case only, changes nothing.
    """
    control = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.EDITOR_CONTROLS.items() for x in kv]), F.col(intent)), F.lit("ASSERT_NEUTRAL"))
    request = tx.render(tx.PROMPTS["edit"], control=control, line=F.coalesce(utterance, F.lit("")))
    rows = per_distinct(lines, request, provider)
    reply = tx.unwrap(tx.strip(F.coalesce("response", F.lit(""))))
    same = (reply == "") | (F.lower(reply) == F.lower(tx.strip(F.coalesce(utterance, F.lit("")))))
    return rows.withColumn("new", F.when(same, F.col(utterance)).otherwise(reply)).drop("prompt_key", "response")
