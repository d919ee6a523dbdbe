"""Three gates that decide whether a line may take slang."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx

#: Share of slang tokens at which a scene is full.
DENSITY = 0.25


def speaker_ok(role: str = "social_role", level: str = "slang_level") -> Column:
    """Gate 1: no elders, no authority, no speaker with slang level 0; unknown speakers pass."""
    r, n = F.coalesce(F.col(role), F.lit("peer")), F.coalesce(F.col(level), F.lit(5))
    return ~r.isin("elder", "authority") & (n != 0)


def intent_ok(intent: str | Column) -> Column:
    """Gate 2: the intent lets slang in."""
    return F.coalesce((F.col(intent) if isinstance(intent, str) else intent).isin(lx.SLANG_INTENTS), F.lit(False))


def density_fold(lines: Column, threshold: float = DENSITY) -> Column:
    """Gate 3 over a scene's lines (line_idx, tokens, added, candidate) in order.

    A candidate's tokens count before it is tested, blocked or not; what is added counts
    only where the gate is open. Each line gets ``open`` and the totals after it.
    """
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("slang"), F.array().cast("array<struct<line_idx:bigint,open:boolean,total:bigint,slang:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total = F.when(x["candidate"], acc["total"] + x["tokens"]).otherwise(acc["total"])
        is_open = x["candidate"] & ((total == 0) | (acc["slang"] / F.greatest(total, F.lit(1)) < threshold))
        slang = F.when(is_open, acc["slang"] + x["added"]).otherwise(acc["slang"])
        line = F.struct(x["line_idx"].cast("long").alias("line_idx"), is_open.alias("open"), total.alias("total"), slang.alias("slang"))
        return F.struct(total.alias("total"), slang.alias("slang"), F.array_append(acc["out"], line).alias("out"))

    return F.aggregate(F.array_sort(lines), start, step, lambda acc: acc["out"])


def gate_lines(lines: DataFrame, keys: list[str], intent: str = "intent", tokens: str = "tokens", added: str = "added", threshold: float = DENSITY) -> DataFrame:
    """Adds go, gate_stopped (1, 2, 3 or null), intent (null if gate 1 stops) and a reason.

    Needs social_role, slang_level, line_idx, speaker; the first failing gate counts. A
    scene's lines are folded in one row: scenes are short by nature, a stream isn't one.
    """
    one, two = speaker_ok(), intent_ok(intent)
    rows = lines.withColumn("_one", one).withColumn("_two", two)
    item = F.struct(F.col("line_idx").cast("long").alias("line_idx"), F.col(tokens).cast("long").alias("tokens"), F.col(added).cast("long").alias("added"), (F.col("_one") & F.col("_two")).alias("candidate"))
    decided = rows.groupBy(*keys).agg(density_fold(F.collect_list(item), threshold).alias("d"))
    decided = decided.select(*keys, F.inline("d"))
    rows = rows.withColumn("line_idx", F.col("line_idx").cast("long")).join(decided, [*keys, "line_idx"])
    stopped = F.when(~F.col("_one"), 1).when(~F.col("_two"), 2).when(~F.col("open"), 3)
    reason = (
        F.when(~F.col("_one"), F.concat(F.lit("speaker "), F.coalesce("speaker", F.lit("")), F.lit(" takes no slang")))
        .when(~F.col("_two"), F.concat(F.lit("intent "), F.coalesce(intent, F.lit("")), F.lit(" takes no slang")))
        .when(~F.col("open"), F.lit("scene is full"))
        .otherwise(F.lit("all gates passed"))
    )
    rows = rows.withColumn("go", F.col("open")).withColumn("gate_stopped", stopped).withColumn("reason", reason)
    return rows.withColumn("intent", F.when(F.col("_one"), F.col(intent))).drop("_one", "_two", "open")


def density_report(gated: DataFrame, keys: list[str], threshold: float = DENSITY) -> DataFrame:
    """Totals, density and whether there is room, of each scene that passed gates 1 and 2 at all."""
    rows = gated.filter("gate_stopped is null or gate_stopped = 3").groupBy(*keys)
    rows = rows.agg(F.max_by("total", "line_idx").alias("total_tokens"), F.max_by("slang", "line_idx").alias("slang_tokens"))
    share = F.when(F.col("total_tokens") > 0, F.col("slang_tokens") / F.greatest(F.col("total_tokens"), F.lit(1))).otherwise(F.lit(0.0))
    return rows.select(*keys, "total_tokens", "slang_tokens", F.round(share, 3).alias("density"), (share < threshold).alias("under_budget"))
