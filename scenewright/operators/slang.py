"""Slang lexicons, pools of candidates, and choosing among them."""

from __future__ import annotations

import hashlib
import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from .relational import unit_hash, weighted_sample


def lexicon_counts(pairs: DataFrame, control: str = "control", function: str = "function", slangs: str = "slangs") -> DataFrame:
    """key_kind, key, slang, cnt: how often each slang, in lower case, goes with a control and with a function; one pass for both."""
    rows = pairs.select(F.col(control).alias("control"), F.col(function).alias("function"), F.explode(slangs).alias("s"))
    rows = rows.select(F.lower("s").alias("slang"), F.explode(F.array(F.struct(F.lit("control").alias("key_kind"), F.col("control").alias("key")), F.struct(F.lit("function").alias("key_kind"), F.col("function").alias("key")))).alias("k"))
    return rows.groupBy("k.key_kind", "k.key", "slang").agg(F.count("*").alias("cnt"))


def lexicon_sets(pairs: DataFrame, key: str, slangs: str = "slangs") -> DataFrame:
    """The distinct slangs of each non-empty key, sorted, with case."""
    rows = pairs.select(F.col(key).alias("key"), F.explode(slangs).alias("slang")).filter("key <> '' and slang <> ''")
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("slang")).alias("slangs"))


def filler_pool(pairs: DataFrame, function: str = "function", slangs: str = "slangs") -> list[str]:
    """The distinct fillers; four defaults where there is none. A lexicon's size: goes to the driver."""
    rows = pairs.filter(F.col(function) == "filler").select(F.explode(slangs).alias("s")).filter("s <> ''").distinct().collect()
    return sorted(r["s"] for r in rows) or sorted(lx.DEFAULT_FILLERS)


def phrase_lexicon(pairs: DataFrame, slangs: str = "slangs") -> DataFrame:
    """Distinct phrases in lower case."""
    return pairs.select(F.explode(slangs).alias("s")).select(tx.strip(F.lower("s")).alias("phrase")).filter("phrase <> ''").distinct()


def word_lexicon(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Distinct words of the phrases."""
    return phrases.select(F.explode(tx.words(phrase)).alias("word")).distinct()


def slang_frequency(pairs: DataFrame, slang: str = "slang", control: str = "control") -> DataFrame:
    """Rows and distinct controls of each slang."""
    return pairs.groupBy(slang).agg(F.count("*").alias("freq"), F.array_sort(F.collect_set(control)).alias("controls"))


def frequent_new_words(pairs: DataFrame, source: str, target: str, at_least: int = 2, stop: list[str] | None = None) -> DataFrame:
    """word, df: words of the target that its source lacks, in ``at_least`` pairs, of two letters or more, no stop words."""
    new = pairs.select(F.explode(F.array_except(tx.words(target), tx.words(source))).alias("word"))
    out = new.groupBy("word").agg(F.count("*").alias("df")).filter((F.col("df") >= at_least) & (F.length("word") >= 2))
    return out.filter(~F.col("word").isin(lx.GRAMMAR_WORDS if stop is None else stop))


def control_map(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])


def controls_of(intent: str | Column, emotion: str | Column) -> Column:
    """Control tokens that an intent and a mood call for."""
    none = F.array().cast("array<string>")
    one = F.coalesce(F.try_element_at(control_map(lx.INTENT_CONTROLS), tx.col(intent)), none)
    two = F.coalesce(F.try_element_at(control_map(lx.EMOTION_CONTROLS), F.lower(F.coalesce(tx.col(emotion), F.lit("neutral")))), none)
    return F.array_union(one, two)


def pools(wanted: DataFrame, by_control: DataFrame, by_function: DataFrame, fillers: list[str]) -> DataFrame:
    """intent, emotion and the sorted pool of slang for each of them.

    Fewer than six are enriched with colourful functions, fewer than four then with fillers.
    """
    moods = wanted.select("intent", "emotion").distinct()
    none = F.array().cast("array<string>")
    hit = moods.select("intent", "emotion", F.explode(controls_of("intent", "emotion")).alias("key")).join(by_control, "key")
    base = hit.select("intent", "emotion", F.explode("slangs").alias("s")).groupBy(F.col("intent").alias("_i"), F.col("emotion").alias("_e")).agg(F.collect_set("s").alias("base"))
    more = by_function.filter(F.col("key").isin(lx.COLOURFUL_FUNCTIONS)).select(F.explode("slangs").alias("s")).agg(F.collect_set("s").alias("m")).first()["m"]
    rows = moods.join(base, F.col("intent").eqNullSafe(F.col("_i")) & F.col("emotion").eqNullSafe(F.col("_e")), "left")
    rows = rows.select("intent", "emotion", F.coalesce("base", none).alias("p"))
    lits = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<string>")
    rows = rows.withColumn("p", F.when(F.size("p") < 6, F.array_union("p", lits(more))).otherwise(F.col("p")))
    rows = rows.withColumn("p", F.when(F.size("p") < 4, F.array_union("p", lits(fillers))).otherwise(F.col("p")))
    return rows.select("intent", "emotion", F.array_sort("p").alias("pool"))


def candidate_weight(slang: str = "slang", used: str | None = None, last: str | None = None) -> Column:
    """Rarer slang weighs more; the last one used and the two plainest fillers weigh less."""
    w = F.lit(1.0) / (F.lit(1) + (F.col(used) if used else F.lit(0)))
    if last:
        w = w * F.when(F.col(slang) == F.col(last), 0.05).otherwise(1.0)
    return w * F.when(F.lower(slang).isin("bhai", "yaar"), 0.35).otherwise(1.0)


def candidates(lines: DataFrame, keys: list[str], pool: str = "pool", k: int = 5, seed: str = "1") -> DataFrame:
    """Up to k distinct slangs for each line, by weight; the draw is a hash of line and slang."""
    rows = lines.select(*keys, F.explode(pool).alias("slang"))
    return weighted_sample(rows, keys, candidate_weight(), unit_hash(F.lit(seed), *keys, "slang"), k, "slang")


def usage_fold(lines: DataFrame, story: str, order: list[str], pool: str = "pool", k: int = 5, seed: str = "") -> DataFrame:
    """Candidates with feedback: what a line took lowers its weight on later lines of the story.

    Each line takes the first of its candidates. Every choice depends on those before, so a
    story is walked in order by one task; it streams through in Arrow batches, and what is
    carried is the use of each slang, so a very long story needs no more memory than a short
    one. Stories are independent of each other. A null pool gives no candidates.
    """
    kept = [story, *order]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*kept).schema)
    name = F.coalesce(F.col(story).cast("string"), F.lit("\u0000"))
    rows = lines.select(*kept, F.col(pool).alias("_pool"), name.alias("_story")).repartition("_story").sortWithinPartitions("_story", *order)

    def run(batches):
        here, used, last, i = None, {}, None, 0
        for batch in batches:
            chosen, taken = [], []
            for of, items in zip(batch.column("_story").to_pylist(), batch.column("_pool").to_pylist()):
                if of != here:
                    here, used, last, i = of, {}, None, 0
                draws = []
                for s in items or []:
                    w = 1.0 / (1 + used.get(s, 0)) * (0.05 if s == last else 1.0) * (0.35 if s.lower() in ("bhai", "yaar") else 1.0)
                    u = int(hashlib.md5(f"{seed}{of}|{i}|{s}".encode()).hexdigest()[:12], 16) / 16**12
                    draws.append((-math.log(max(u, 1e-15)) / w, s))
                best = [s for _, s in heapq.nsmallest(k, draws)]
                if best:
                    last = best[0]
                    used[last] = used.get(last, 0) + 1
                chosen.append(best)
                taken.append(best[0] if best else None)
                i += 1
            made = [pa.array(chosen, pa.list_(pa.string())), pa.array(taken, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "candidates", "taken"])

    return rows.mapInArrow(run, f"{fields}, candidates array<string>, taken string")


def place(line: str | Column, slang: str | Column) -> Column:
    """A rule that stands in for a model: the slang goes to the end of the line."""
    base = F.regexp_replace(tx.strip(line), r"[.!?]+$", "")
    return F.when(tx.col(slang).isNull(), tx.col(line)).otherwise(tx.unwrap(F.concat(base, F.lit(", "), tx.col(slang))))
