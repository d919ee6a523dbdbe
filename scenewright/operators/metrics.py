"""Metrics of scenes, scripts and editors."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions import lexicons as lx
from ..functions import text as tx

#: Phrases up to which a lexicon is shipped with the tasks.
LEXICON_LIMIT = 2_000_000


def inserted_words(neutral: str, slang: str) -> Column:
    """Words of ``slang`` beyond those of ``neutral``, as often as they are more; sorted."""
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))

    def more(both: Column) -> Column:
        a, b = both["a"], both["b"]
        # Words that only one side has need no counting against the other.
        shared = F.array_intersect(b, a)
        fresh = F.filter(b, lambda w: ~F.array_contains(shared, w))
        again = F.flatten(F.transform(shared, lambda w: F.array_repeat(w, F.greatest(times(b, w) - times(a, w), F.lit(0)))))
        return F.array_sort(F.concat(fresh, again))

    return tx.bound(F.struct(tx.words(neutral).alias("a"), tx.words(slang).alias("b")), more)


def slang_finder(phrases: list[str], words: list[str]):
    """A function over Arrow batches whose last four columns are inserted words, slang text, neutral text and slang lines, in lower case.

    One automaton finds all phrases, however many there are.
    """

    def find(batches):
        auto, known = ahocorasick.Automaton(), set(words)
        for p in phrases:
            auto.add_word(p, p)
        if phrases:
            auto.make_automaton()
        found = lambda t: {p for _, p in auto.iter(t)} if phrases else set()
        for batch in batches:
            out = []
            for ins, s, n, ls in zip(*(c.to_pylist() for c in batch.columns[-4:])):
                hits = sorted(found(s) - found(n))
                inside = {w for p in hits for w in re.findall("[a-z]+", p)}
                valid = [w for w in ins if w in known]
                detected = hits + [w for w in valid if w not in inside]
                out.append((valid, hits, detected, sum(any(t in line for t in detected) for line in ls)))
            strings = pa.list_(pa.string())
            cols = [pa.array([r[k] for r in out], strings if k < 3 else pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *cols], [*batch.schema.names[:-3], "valid", "phrase_hits", "detected", "lines_with"])

    return find


def lexicon_list(df: DataFrame, column: str) -> list[str]:
    """A lexicon on the driver, if it is as small as a lexicon is."""
    rows = df.select(column).filter(F.col(column) != "").limit(LEXICON_LIMIT + 1).collect()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError(f"more than {LEXICON_LIMIT} phrases: join them as rows instead")
    return sorted(r[0] for r in rows)


def detect_slang(pairs: DataFrame, phrases: DataFrame, singles: DataFrame, neutral: str = "neutral", slang: str = "slang") -> DataFrame:
    """Adds inserted, valid, phrase_hits, detected and lines_with (lines that hold a detected term).

    Phrases of several words count once where the slang side has them and the neutral side
    doesn't; single words count as often as they were inserted, unless a found phrase has them.
    """
    multi = [p for p in lexicon_list(phrases, "phrase") if " " in p]
    find = slang_finder(multi, lexicon_list(singles, "word"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    lines = F.transform(tx.nonblank_lines(slang), lambda ln: F.lower(tx.strip_speaker(ln)))
    rows = pairs.select(*pairs.columns, inserted_words(neutral, slang).alias("inserted"), low(slang).alias("_s"), low(neutral).alias("_n"), lines.alias("_l"))
    schema = StructType([f for f in rows.schema if f.name not in ("_s", "_n", "_l")])
    for name in ("valid", "phrase_hits", "detected"):
        schema = schema.add(name, ArrayType(StringType()))
    return rows.mapInArrow(find, schema.add("lines_with", IntegerType()))


def scene_metrics(detected: DataFrame, slang: str = "slang") -> DataFrame:
    """Adds n_lines, n_slang, coverage, density, validity and the code-mixing index."""
    lines = tx.nonblank_lines(slang)
    n = F.greatest(F.size(lines), F.lit(1))
    rows = detected.withColumn("_m", tx.code_mixing(slang))
    return rows.select(
        "*", F.size(lines).alias("n_lines"), F.size("detected").alias("n_slang"), (F.col("lines_with") / n).alias("coverage"), (F.size("detected") / n).alias("density"),
        F.when(F.size("inserted") > 0, F.size("valid") / F.greatest(F.size("inserted"), F.lit(1))).otherwise(F.lit(1.0)).alias("validity"),
        F.col("_m.cmi").alias("cmi"), F.col("_m.en_ratio").alias("en_ratio"), F.col("_m.hi_ratio").alias("hi_ratio"),
    ).drop("_m")


def script_rollup(scenes: DataFrame) -> DataFrame:
    """One row: means over scenes, total and distinct slang, diversity."""
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    flat = scenes.select(F.explode("detected").alias("t")).agg(F.count("*").alias("slang_total"), F.count_distinct(F.lower("t")).alias("slang_unique"))
    rows = scenes.agg(
        F.count("*").alias("scenes"), mean("coverage", "slang_coverage"), mean("density", "slang_density"), mean("validity", "slang_validity"),
        mean("cmi", "cmi_mean"), mean("en_ratio", "en_ratio_mean"), mean("hi_ratio", "hi_ratio_mean"),
    )
    diversity = F.when(F.col("slang_total") > 0, F.round(F.col("slang_unique") / F.greatest("slang_total", F.lit(1)), 4)).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(flat), how="inner", on=F.lit(True)).withColumn("slang_diversity", diversity)


def top_slang(scenes: DataFrame, k: int = 8) -> DataFrame:
    """The most frequent terms; ties in order of the term."""
    rows = scenes.select(F.explode("detected").alias("t")).select(F.lower("t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "term").limit(k)


def covered_events(dialogue: str | Column, events: str | Column, stop: list[str] = lx.EVENT_STOP_WORDS) -> Column:
    """covered, total and recall: events any of whose words, stop words aside, is in the dialogue."""
    low = F.lower(F.coalesce(tx.col(dialogue), F.lit("")))
    evs = F.coalesce(tx.col(events), F.array().cast("array<string>"))
    told = lambda text: lambda e: F.exists(F.filter(tx.words(e), lambda w: ~w.isin(stop)), lambda w: F.contains(text, w))
    n = tx.bound(low, lambda text: F.size(F.filter(evs, told(text))))
    counts = F.struct(n.alias("covered"), F.size(evs).alias("total"))
    return tx.bound(counts, lambda k: F.struct(k["covered"].alias("covered"), k["total"].alias("total"), (k["covered"] / F.greatest(k["total"], F.lit(1))).alias("recall")))


def validate(rows: DataFrame, similarity: str = "similarity", recall: str = "recall", min_similarity: float = 0.82, min_recall: float = 0.5) -> DataFrame:
    """Adds passed and action; thresholds meet the unrounded values, results are rounded."""
    ok = (F.col(similarity) >= min_similarity) & (F.col(recall) >= min_recall)
    rows = rows.withColumn("passed", ok).withColumn("action", F.when(ok, "accept").otherwise("rewrite"))
    return rows.withColumn(similarity, F.round(similarity, 4)).withColumn(recall, F.round(recall, 4))


def report(validated: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row: similarity mean and least, mean recall, and the judge's means over scenes it judged."""
    out = validated.agg(
        F.count("*").alias("n_scenes"), F.round(F.avg("similarity"), 4).alias("semantic_sim_mean"), F.round(F.min("similarity"), 4).alias("semantic_sim_min"), F.round(F.avg("recall"), 4).alias("event_recall_mean")
    )
    if judged is not None:
        marks = judged.agg(F.round(F.avg("emotion_fit"), 2).alias("emotion_fit_mean"), F.round(F.avg("placement"), 2).alias("placement_mean"))
        out = out.join(F.broadcast(marks), how="inner", on=F.lit(True))
    return out


def judge_passes(*flags: str) -> Column:
    """All flags hold; a missing one doesn't."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(F.col(f).cast("boolean"), F.lit(False))
    return ok


def editor_metrics(rows: DataFrame, lexicon: DataFrame, prediction: str = "prediction", neutral: str = "neutral", reference: str = "reference") -> DataFrame:
    """One row: slang_hit, copies_input, has_sentinel, matches_ref, edits_made."""
    words = F.array_except(tx.words(prediction), tx.words(neutral))
    r = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(prediction).alias("p"), F.col(neutral).alias("n"), F.col(reference).alias("r"), words.alias("w"))
    hit = r.select("_row", F.explode("w").alias("word")).join(lexicon.select("word").distinct(), "word").select("_row").distinct().agg(F.count("*").alias("hits"))
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 3)
    out = r.agg(F.count("*").alias("n_rows"), share(F.col("p") == F.col("n")).alias("copies_input"), share(F.contains("p", F.lit("<extra_id_"))).alias("has_sentinel"), share(F.col("p") == F.col("r")).alias("matches_ref"), share(F.col("p") != F.col("n")).alias("edits_made"))
    out = out.join(F.broadcast(hit), how="inner", on=F.lit(True))
    return out.select("n_rows", F.round(F.col("hits") / F.greatest("n_rows", F.lit(1)), 3).alias("slang_hit"), "copies_input", "has_sentinel", "matches_ref", "edits_made")


def edit_weight(source: str, target: str, weight: float = 2.0) -> Column:
    """Mean weight of the target's words: ``weight`` where the source lacks the word, else 1."""

    def mean(both: Column) -> Column:
        a, b = both["a"], both["b"]
        total = F.aggregate(b, F.lit(0.0), lambda s, w: s + F.when(F.array_contains(a, w), 1.0).otherwise(float(weight)))
        return F.when(F.size(b) > 0, total / F.greatest(F.size(b), F.lit(1))).otherwise(F.lit(0.0))

    return tx.bound(F.struct(tx.words(source).alias("a"), tx.words(target).alias("b")), mean)
