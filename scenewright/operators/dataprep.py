"""Cleaning slang pairs, checking generated ones, and making editor examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import partial_ratio, token_sort_ratio
from .relational import complement, keep_first, split_by_share

# The raw file's column names, and ours.
RAW_COLUMNS = {
    "neutral hinglish sentence": "neutral", "context": "context", "social_context": "social_context", "Possible Slangs": "possible_slangs", "Slang Location": "slang_location",
    "Multiple positions allowed?": "multiple", "Control tokens": "control_tokens", "function": "function", "output sentence": "output",
}


def stems_present(slangs: str | Column, output: str | Column) -> Column:
    """Whether a slang stands in the output, or an output word starts with the first four letters of one of its words."""
    low = F.lower(F.coalesce(tx.col(output), F.lit("")))
    word_list = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    stem = lambda w: F.when(F.char_length(w) >= 5, F.substring(w, 1, 4)).otherwise(w)

    def present(both: Column) -> Column:
        by_stem = lambda s: F.exists(F.transform(word_list(s), stem), lambda w: F.exists(both["words"], lambda o: F.startswith(o, w)))
        return F.exists(tx.col(slangs), lambda s: F.contains(both["low"], F.lower(s)) | by_stem(s))

    return tx.bound(F.struct(low.alias("low"), word_list(low).alias("words")), present)


def fuzzy_present(rows: DataFrame, slangs: str, output: str, at_least: float = 80.0) -> DataFrame:
    """Adds slang_present: by substring or stem, else by the best fuzzy ratio of any slang.

    Only rows that the cheap tests leave in doubt meet the Python function.
    """
    rows = rows.withColumn("slang_present", stems_present(slangs, output))
    sure, doubt = rows.filter("slang_present"), rows.filter("not coalesce(slang_present, false)")
    tagged = doubt.withColumn("_row", F.struct(*doubt.columns)).select("_row", F.posexplode_outer(slangs).alias("_i", "_s"))
    tagged = tagged.withColumn("_r", F.coalesce(partial_ratio(F.lower("_s"), F.lower(F.col(f"_row.{output}"))), F.lit(0.0)))
    scored = tagged.groupBy("_row").agg(F.max("_r").alias("_r")).select("_row.*", (F.col("_r") >= at_least).alias("_hit"))
    return sure.unionByName(scored.withColumn("slang_present", F.col("_hit")).drop("_hit"))


def clean_pairs(raw: DataFrame, row_id: str = "row_id", fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clean pairs and those set aside, of raw ones with our column names and a row number.

    Missing values are empty strings. Kept: sides that differ and aren't empty and show a
    slang; of equal (neutral, output, control) the first row.
    """
    value = lambda c: tx.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = raw.select(
        row_id, value("neutral").alias("neutral"), value("output").alias("output"), tx.control_token(F.coalesce("control_tokens", F.lit(""))).alias("control"),
        tx.function_name("function").alias("function"), tx.positions("slang_location").alias("positions"), (F.lower(value("multiple")) == "yes").alias("multi_allowed"),
        value("social_context").alias("social_context"), value("context").alias("context"), tx.slang_list("possible_slangs").alias("slangs"),
    )
    rows = fuzzy_present(rows, "slangs", "output") if fuzzy else rows.withColumn("slang_present", stems_present("slangs", "output"))
    good = F.col("slang_present") & (F.lower("neutral") != F.lower("output")) & (F.length("neutral") > 0) & (F.length("output") > 0)
    kept, aside = complement(rows, good)
    return keep_first(kept.drop("slang_present"), ["neutral", "output", "control"], [row_id]), aside


def structural_reason(min_ratio: float | None = None, duplicate: Column | None = None) -> Column:
    """The first thing wrong with (neutral, output, slang), else ok."""
    n, o, s = (F.coalesce(F.col(c), F.lit("")) for c in ("neutral", "output", "slang"))
    out = F.when((n == "") | (o == "") | (s == ""), "empty").when(tx.has_devanagari(n) | tx.has_devanagari(o), "devanagari")
    out = out.when(~F.contains(F.lower(o), F.lower(s)), "slang_absent").when(F.lower(n) == F.lower(o), "no_change")
    out = out.when(~tx.token_count(n).between(4, 26), "length")
    if duplicate is not None:
        out = out.when(duplicate, "duplicate")
    if min_ratio is not None:
        out = out.when(F.col("similarity") < min_ratio, "semantic_drift")
    return out.otherwise("ok")


def without_slang(output: str | Column, slang: str | Column) -> Column:
    """The output without the slang, whatever its case, squeezed and without ``,.!`` at the ends."""
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace(tx.col(slang), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_replace(tx.squeeze(F.regexp_replace(tx.col(output), quoted, F.lit(""))), r"^[ ,.!]+|[ ,.!]+$", "")


def structural_check(rows: DataFrame, seen: DataFrame, order: list[str], novel: bool | Column = False, min_ratio: float | None = 70.0) -> DataFrame:
    """Adds reason, against earlier outputs (``seen``: output, neutral) and earlier rows of the batch.

    A row is a duplicate of a batch row before it only if that one is otherwise good. Rows
    that are ``novel`` may not repeat a neutral line either.
    """
    novel = novel if isinstance(novel, Column) else F.lit(novel)
    rows = rows.withColumn("_ko", tx.dedup_key("output")).withColumn("_kn", F.when(novel, tx.dedup_key("neutral")))
    if min_ratio is not None:
        rows = rows.withColumn("similarity", token_sort_ratio(F.lower("neutral"), F.lower(without_slang("output", "slang"))))
    rows = rows.join(seen.select(tx.dedup_key("output").alias("_ko"), F.lit(True).alias("_old")).distinct(), "_ko", "left")
    rows = rows.join(seen.select(tx.dedup_key("neutral").alias("_kn"), F.lit(True).alias("_oldn")).distinct(), "_kn", "left")
    dup = F.coalesce("_old", F.lit(False)) | F.coalesce("_oldn", F.lit(False))
    rows = rows.withColumn("reason", structural_reason(min_ratio, dup))
    rows = later_repeats(later_repeats(rows, "_ko", order), "_kn", order)
    return rows.drop("_ko", "_kn", "_old", "_oldn")


def later_repeats(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Calls all good rows of a key but the first ``duplicate``; a null key is no key.

    Salted in two steps: of each salt's rows the first, then of those the first. No task
    sorts all rows of a key, and rows with a fault never meet.
    """
    good, some = F.col("reason") == "ok", F.xxhash64(*order) % 1024
    alone = F.when(good & F.col(key).isNotNull(), F.lit(None)).otherwise(F.xxhash64(F.lit(1), *order))
    rows = rows.withColumn("_lead", F.row_number().over(W.partitionBy(key, alone, some).orderBy(*order)) == 1)
    rest = F.when(F.col("_lead"), F.lit(None)).otherwise(some)
    first = F.row_number().over(W.partitionBy(key, alone, rest).orderBy(*order)) == 1
    late = good & F.col(key).isNotNull() & ~(F.col("_lead") & first)
    return rows.withColumn("reason", F.when(late, "duplicate").otherwise(F.col("reason"))).drop("_lead")


def distinct_controls(pairs: DataFrame, control: str = "control") -> DataFrame:
    """The control tokens that occur."""
    return pairs.select(F.col(control).alias("control")).distinct()


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rows of each reason and their share in hundredths."""
    out = checked.groupBy("reason").agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def editor_examples(pairs: DataFrame, order: list[str]) -> DataFrame:
    """input, target of pairs whose sides differ; of equal ones the first."""
    rows = pairs.filter(F.lower("neutral") != F.lower("output"))
    rows = rows.withColumn("input", F.concat(F.lit("insert slang | control: "), F.col("control"), F.lit(" | "), F.col("neutral"))).withColumn("target", F.col("output"))
    return keep_first(rows, ["input", "target"], order)


def editor_split(examples: DataFrame, share: float = 0.08) -> DataFrame:
    """Adds is_validation; the first ``floor(share * n)`` in hash order."""
    return split_by_share(examples, share, "input", "target")
