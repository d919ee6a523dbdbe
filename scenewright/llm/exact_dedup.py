"""Exact duplicate removal by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical without white space. Three levels, each
over fixed-width columns and only over what the level before left in doubt:

1. length of the normalised text: a length held by one row ends the matter;
2. hash of its first characters, among rows that share a length;
3. SHA-256 of the whole text, among rows that share length and prefix.

Text is read once and never shuffled. All rows that are alone at a level leave as
groups of one; only surviving rows are grouped by the full hash. The full hash is
made in the scan, where the text already is: shipping the survivors' text to a second
scan costs more than hashing it, and callers want the digest of every row.

A length, a prefix or a group may hold a third of all rows: counts are summed before
the exchange and every join back to rows is salted, so no task gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checkpointed, salt, with_salts

#: Tasks over which the rows of one length, prefix or group are spread.
SALTS = 16
#: Characters of the normalised text in the second level's hash.
PREFIX_CHARS = 64


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code points, normalised length, prefix hash and full SHA-256 of each row."""
    norm = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("code_points"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS + "+", "").alias("norm"),
    )
    return norm.select(
        "id",
        "code_points",
        F.octet_length("norm").alias("length"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"),
        F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("full"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, full``.

    Of equal texts the row with the most code points stays, then the smallest id.
    Null text counts as empty. Empty texts are equal to each other. A null id sorts
    after all others. Rows repeated with one id count in ``group_size`` and share
    ``kept``. Other columns are ignored; an empty table gives an empty result.
    """
    rows = checkpointed(signatures(docs, id_col, text_col).withColumn("_salt", salt("id", "full", salts=salts)))

    def among(at: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose ``keys`` are held by two rows at least."""
        shared = at.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
        return at.join(with_salts(shared, salts), [*keys, "_salt"], "left_semi")

    same_length = among(rows, ["length"])
    same_prefix = among(same_length, ["length", "prefix"])
    best = F.min(F.struct((-F.col("code_points")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("i")))
    groups = same_prefix.groupBy("length", "prefix", "full").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    groups = groups.select("length", "prefix", "full", "group_size", F.col("best.i").alias("keep_id"))
    out = rows.join(with_salts(groups, salts), ["length", "prefix", "full", "_salt"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        "id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
        "full",
    )
