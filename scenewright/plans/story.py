"""Story to screenplay: the whole run over many stories at once."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import characters as ch
from ..operators import gates, metrics, scenes, slang
from ..operators.relational import carry_over, zip_join
from . import providers as pv

MAX_ATTEMPTS = 3


@dataclass
class Models:
    """The model steps of a run; by default rules that stand in for them."""

    events: pv.Provider
    dialogue: pv.Provider
    intent: pv.Provider
    similarity: Column  # of neutral and slang dialogue
    editor: pv.Provider | None = None  # rewrites lines in place of the draw of slang


def rules() -> Models:
    """Rules for every model step: a scene's text is its event, its capitalised names its characters."""
    names = ch.persons("text")
    events = F.concat(F.lit("["), F.to_json(F.struct(F.array("text").alias("key_events"), names.alias("characters"), F.col("text").alias("scene_goal"))), F.lit("]"))
    same = F.size(F.array_intersect(tx.words("neutral"), tx.words("slang"))) / F.greatest(F.size(F.array_distinct(tx.words("neutral"))), F.lit(1))
    return Models(pv.rule(events), pv.rule(F.col("text")), pv.rule(pv.keyword_intent()), same)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, without its lineage, in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="scenewright-"))
    return df.checkpoint()


def neutral_pass(events: DataFrame, chunks: DataFrame, models: Models) -> DataFrame:
    """story_id, scene_idx, scene_id, key_events, neutral: dialogue for every scene with an event."""
    rows = zip_join(chunks.select("story_id", "scene_idx", "text"), events.drop("text"))
    speaker = F.coalesce(F.get("characters", F.lit(0)), F.lit("SPEAKER"))
    rows = models.dialogue(rows.withColumn("prompt_key", F.concat_ws("|", "story_id", "scene_id")))
    return rows.select("story_id", "scene_idx", "scene_id", "key_events", pv.dialogue_of("response", speaker, F.col("scene_goal")).alias("neutral"))


def drawn(spoken: DataFrame, pool: DataFrame, keys: list[str], attempt: int) -> DataFrame:
    """Adds pick. What a line of the story took weighs less on its later lines, over all scenes of the pass.

    Lines that the speaker or the intent gate stops take nothing and use nothing up; one
    that only the density gate stops does, as that gate needs the line first.
    """
    pool = pool.select(F.col("intent").alias("_i"), F.col("emotion").alias("_e"), "pool")
    may = spoken.filter(gates.speaker_ok() & gates.intent_ok("intent"))
    may = may.join(pool, F.col("intent").eqNullSafe(F.col("_i")) & F.col("current_emotion").eqNullSafe(F.col("_e")))
    picks = slang.usage_fold(may, keys[0], [*keys[1:], "line_idx"], k=1, seed=f"{attempt}|")
    return spoken.join(picks.select(*keys, "line_idx", F.col("taken").alias("pick")), [*keys, "line_idx"], "left")


def slang_pass(neutral: DataFrame, profiles: DataFrame, pool: DataFrame, models: Models, attempt: int) -> DataFrame:
    """Adds slang and decisions to neutral scenes; budgets start afresh."""
    keys = ["story_id", "scene_idx"]
    lines = scenes.dialogue_lines(neutral, keys, "neutral")
    spoken = pv.classify_intents(ch.with_profile(lines.filter("is_dialogue"), profiles, ["story_id"]), models.intent)
    if models.editor is None:
        spoken = drawn(spoken, pool, keys, attempt).withColumn("new", slang.place("utterance", "pick"))
    else:
        spoken = pv.edit_lines(spoken, models.editor).withColumn("pick", F.lit(None).cast("string"))
    spoken = spoken.withColumn("tokens", tx.token_count("utterance"))
    changed = F.col("new") != F.col("utterance")
    spoken = spoken.withColumn("added", F.when(changed, F.greatest(F.lit(1), tx.token_count("new") - F.col("tokens"))).otherwise(F.lit(0)))
    gated = gates.gate_lines(spoken, keys)
    said = F.concat("speaker", F.lit(": "), F.when(F.col("go"), F.col("new")).otherwise(F.col("utterance")))
    decision = F.struct("speaker", (F.col("go") & (F.col("added") > 0)).alias("applied"), "go", "gate_stopped", "intent", "reason", F.col("pick").alias("slang"))
    done = gated.select(*keys, "line_idx", said.alias("line"), decision.alias("decision"))
    plain = lines.filter("not is_dialogue").select(*keys, F.col("line_idx").cast("long").alias("line_idx"), "line")
    every = done.unionByName(plain, allowMissingColumns=True)
    built = F.array_sort(F.collect_list(F.struct("line_idx", "line", "decision")))
    every = every.groupBy(*keys).agg(built.alias("b"))
    every = every.select(*keys, F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("slang"), F.filter(F.transform("b", lambda x: x["decision"]), lambda d: d.isNotNull()).alias("decisions"))
    return neutral.join(every, keys, "left").withColumn("slang", F.coalesce("slang", F.lit("")))


def validated(scenes_: DataFrame, models: Models) -> DataFrame:
    rows = scenes_.withColumn("similarity", models.similarity).withColumn("recall", metrics.covered_events("slang", "key_events")["recall"])
    return metrics.validate(rows)


def run(stories: DataFrame, pairs: DataFrame, models: Models | None = None, devanagari: bool = True, max_attempts: int = MAX_ATTEMPTS) -> dict[str, DataFrame]:
    """All tables of a run: chunks, events, profiles, scenes (validated), script.

    Scenes that fail validation are done again until none fails or attempts are used up;
    each pass works on the failed ones only, and passing results are carried over.
    """
    models = models or rules()
    chunks = cut(scenes.romanized_chunks(stories) if devanagari else scenes.scene_chunks(stories))
    events = cut(pv.extract_events(scenes.previous_goal(chunks.withColumn("scene_goal", F.col("text"))), models.events))
    if not events.filter("key_events is null").isEmpty():
        raise RuntimeError("event extraction failed for a scene")
    names = ch.names_of(zip_join(chunks.select("story_id", "scene_idx"), events))
    first = ch.first_profiles(names.join(chunks.select("story_id", "scene_idx", "text"), ["story_id", "scene_idx"]))
    moods = names.join(events.select("story_id", "scene_idx", F.array_join("key_events", " ").alias("told")), ["story_id", "scene_idx"])
    moods = moods.withColumn("low", F.lower("name")).withColumn("trigger", ch.triggered_emotion("told"))
    states = ch.final_states(moods, ["story_id", "low"], ["scene_idx", "pos"], "trigger")
    profiles = ch.new_profiles(first, "text").withColumn("low", F.lower("name")).drop("current_emotion", "turn_count", "stress_index")
    profiles = cut(profiles.join(states.withColumnRenamed("emotion", "current_emotion"), ["story_id", "low"]).drop("low", "text", "pos"))
    moods_seen = profiles.select(F.col("current_emotion").alias("emotion")).union(stories.sparkSession.createDataFrame([("neutral",)], "emotion string")).distinct()
    wanted = stories.sparkSession.createDataFrame([(i,) for i in slang.lx.INTENTS], "intent string").join(F.broadcast(moods_seen), how="inner", on=F.lit(True))
    pool = cut(slang.pools(wanted, slang.lexicon_sets(pairs, "control"), slang.lexicon_sets(pairs, "function"), slang.filler_pool(pairs)))
    neutral = cut(neutral_pass(events, chunks, models))
    keys = ["story_id", "scene_idx"]
    done = cut(validated(slang_pass(neutral, profiles, pool, models, 1), models))
    for attempt in range(2, max_attempts + 1):
        failed = done.filter("not passed").select(*keys)
        if failed.isEmpty():
            break
        again = validated(slang_pass(neutral.join(failed, keys, "left_semi"), profiles, pool, models, attempt), models)
        done = cut(carry_over(done, again, failed, keys))
    script = scenes.screenplay(done, ["story_id"], "scene_idx", "scene_id", "slang")
    return {"chunks": chunks, "events": events, "profiles": profiles, "scenes": done, "script": script}
