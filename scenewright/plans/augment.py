"""New slang pairs from old ones, in rounds, until enough are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment as au
from ..operators.relational import union_all, unit_hash, usage_cap
from . import providers as pv
from .story import cut


def generate(pairs: DataFrame, key: list[str], wanted: int, generator: pv.Provider, judge: pv.Provider, rounds: int = 6, min_ratio: float | None = 70.0, seed: str = "7") -> tuple[DataFrame, DataFrame]:
    """Pairs kept, ``wanted`` at most, and attempts set aside with their reason.

    ``pairs`` has the key, neutral, output, control and slangs. A round makes about
    ``wanted`` attempts at once; use of slang, outputs and lines so far count from one round
    to the next, where a sequential run would count them from attempt to attempt.
    """
    items = cut(au.lexicon_items(pairs))
    n = pairs.count()
    share = min(1.0, wanted / n) if n else 0.0
    old = pairs.select(F.coalesce("output", F.lit("")).alias("output"), F.coalesce("neutral", F.lit("")).alias("neutral"))
    cap = usage_cap(wanted)
    kept = aside = None
    for i in range(1, rounds + 1):
        used = kept.groupBy("slang").agg(F.count("*").alias("used")) if kept is not None else None
        attempts = au.attempts_of(pairs, key, share, f"{seed}|{i}")
        drawn = au.draw_slang(attempts, au.draw_pools(items, used, cap), key, f"{seed}|{i}").withColumn("prompt", au.prompt())
        asked = generator(drawn.withColumn("prompt_key", F.md5("prompt"))).drop("prompt", "prompt_key")
        seen = old if kept is None else union_all(old, kept.select("output", "neutral"))
        done = cut(au.outcomes(asked, seen, key, judge, min_ratio).withColumn("round", F.lit(i)))
        good, bad = done.filter("reason = 'ok'"), done.filter("reason <> 'ok'")
        kept, aside = (good, bad) if kept is None else (union_all(kept, good), union_all(aside, bad))
        if kept.count() >= wanted:
            break
    order = ["round", unit_hash(F.lit(seed), "round", *key), *key]
    return kept.orderBy(*order).limit(wanted).drop("reason"), aside
