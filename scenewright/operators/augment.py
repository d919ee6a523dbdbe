"""Drawing slang for new pairs, and what becomes of each attempt at one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from .dataprep import structural_check
from .metrics import judge_passes
from .relational import complement, mode_mix, union_all, unit_hash

#: Settings of new lines, by default.
CONTEXTS = ["canteen", "bus ride", "exam hall", "cricket ground", "family lunch", "night shift", "rainy evening", "shopping street"]
#: What a judge must grant.
VERDICTS = ["is_hinglish", "grammatical", "meaning_preserved", "intent_match", "is_real_slang"]


def draw_weight(used: Column, freq: Column) -> Column:
    """Slang that this run used or that the data has often weighs less."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(3.0) * used + F.lit(0.1) * freq)


def lexicon_items(pairs: DataFrame, control: str = "control", slangs: str = "slangs") -> DataFrame:
    """control, slang, freq: the distinct slang of each control, with its count over all pairs.

    Slang of pairs without a control counts in ``freq`` only.
    """
    token = F.upper(tx.strip(F.coalesce(control, F.lit(""))))
    rows = pairs.select(token.alias("control"), F.explode(slangs).alias("s")).select("control", tx.strip("s").alias("slang")).filter("slang <> ''")
    counts = rows.groupBy("control", "slang").agg(F.count("*").alias("n"))
    counts = counts.withColumn("freq", F.sum("n").over(W.partitionBy("slang")))  # a slang has one row a control here
    return counts.filter("control <> ''").drop("n")


def draw_pools(items: DataFrame, used: DataFrame | None = None, cap: Column | int | None = None) -> DataFrame:
    """control, pool (slang, weight): what may be drawn for each control, and for any other under ''.

    ``used`` (slang, used) is what the run has taken so far. Slang at the cap is left out
    unless all of the pool is. A slang of several controls stands in the pool of all with
    as many times its weight.
    """
    rows = items.join(used.select("slang", "used"), "slang", "left") if used is not None else items.withColumn("used", F.lit(0))
    n = F.coalesce("used", F.lit(0))
    rows = rows.select("control", "slang", draw_weight(n, F.col("freq")).alias("weight"), (F.lit(True) if cap is None else n < cap).alias("free"))
    whole = rows.groupBy("slang").agg(F.sum("weight").alias("weight"), F.first("free").alias("free")).withColumn("control", F.lit(""))
    pools = rows.unionByName(whole).groupBy("control").agg(F.array_sort(F.collect_list(F.struct("slang", "weight", "free"))).alias("pool"))
    return pools.select("control", tx.bound(F.filter("pool", lambda s: s["free"]), lambda free: F.when(F.size(free) > 0, free).otherwise(F.col("pool"))).alias("pool"))


def draw_slang(attempts: DataFrame, pools: DataFrame, key: list[str], seed: str = "1") -> DataFrame:
    """Adds slang: one draw by weight for each attempt, from its control's pool, else from that of all.

    The least ``-ln(u) / weight`` of the pool wins, u a hash of seed, key and slang. Pools are
    joined as they are; no row per attempt and slang is made. Without any slang it is null.
    """
    known = pools.select(F.col("control").alias("control"), F.col("control").alias("_known"))
    rows = attempts.join(known, "control", "left").withColumn("_pool", F.coalesce("_known", F.lit("")))
    rows = rows.join(pools.select(F.col("control").alias("_pool"), "pool"), "_pool", "left")

    def race(s: Column) -> Column:
        u = F.greatest(unit_hash(F.lit(seed), *key, s["slang"]), F.lit(1e-15))
        return F.struct((-F.ln(u) / s["weight"]).alias("k"), s["slang"].alias("slang"))

    return rows.withColumn("slang", F.array_min(F.transform("pool", race))["slang"]).drop("pool", "_pool", "_known")


def attempts_of(pairs: DataFrame, key: list[str], share: float, seed: str, controls: list[str] | None = None, contexts: list[str] | None = None) -> DataFrame:
    """key, mode, neutral, control, context: one attempt for each of a share of the pairs, by hash.

    A variant keeps the pair's line and control; a novel one has any of ``controls`` and a context.
    """
    controls = controls or sorted(set(lx.CANONICAL_CONTROLS.values()))
    contexts = contexts or CONTEXTS
    any_of = lambda name, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(unit_hash(F.lit(f"{seed}|{name}"), *key) * len(xs)) + 1).cast("int"))
    rows = pairs.filter((unit_hash(F.lit(f"{seed}|take"), *key) < share) & (tx.strip("neutral") != ""))
    rows = rows.withColumn("mode", mode_mix(unit_hash(F.lit(f"{seed}|mode"), *key)))
    variant = F.col("mode") == "variant"
    own = F.upper(tx.strip(F.coalesce("control", F.lit(""))))
    own = F.when(own == "", "ASSERT_NEUTRAL").otherwise(own)
    return rows.select(
        *key, "mode", F.when(variant, tx.strip("neutral")).alias("neutral"), F.when(variant, own).otherwise(any_of("control", controls)).alias("control"),
        F.when(variant, "").otherwise(any_of("context", contexts)).alias("context"),
    )


def prompt() -> Column:
    """What a generator is asked for an attempt."""
    insert, novel = tx.render(tx.PROMPTS["insert"], neutral="neutral", slang="slang"), tx.render(tx.PROMPTS["novel"], context="context", control="control", slang="slang")
    return F.when(F.col("mode") == "variant", insert).otherwise(novel)


def outcomes(asked: DataFrame, seen: DataFrame, key: list[str], judge, min_ratio: float | None = 70.0) -> DataFrame:
    """Adds output and reason to attempts with a generator's ``response``; ``ok`` rows are kept, the rest set aside.

    In turn: no reply (``api_error``), no JSON (``unparseable``), the structural check
    against ``seen`` and the batch, then the judge, a provider asked for sound rows only
    (``judge_reject``). A repeat of a row that only the judge rejects is a duplicate still.
    """
    reply = asked.withColumn("_o", tx.json_object("response", "neutral string, output string"))
    value = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    variant = F.col("mode") == "variant"
    reply = reply.withColumn("neutral", F.when(variant, value(F.col("neutral"))).otherwise(value(F.col("_o.neutral")))).withColumn("output", value(F.col("_o.output")))
    read, broken = complement(reply, F.col("_o").isNotNull())
    broken = broken.withColumn("reason", F.when(F.col("response").isNull(), "api_error").otherwise("unparseable"))
    sound, faulty = complement(structural_check(read.drop("_o", "response"), seen, key, ~variant, min_ratio), F.col("reason") == "ok")
    request = tx.render(tx.PROMPTS["verdict"], neutral="neutral", slang="slang", output="output", control="control")
    judged = judge(sound.withColumn("prompt_key", F.md5(request)))
    judged = judged.withColumn("_v", tx.json_object("response", ", ".join(f"{v} boolean" for v in VERDICTS)))
    judged = judged.withColumn("reason", F.when(judge_passes(*[f"_v.{v}" for v in VERDICTS]), "ok").otherwise("judge_reject"))
    return union_all(judged.drop("_v", "prompt_key", "response"), faulty, broken.drop("_o", "prompt_key", "response"))
