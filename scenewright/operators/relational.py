"""Joins, set operations, dedup, ranking and sampling that the text operators are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("story_id", "scene_idx")) -> DataFrame:
    """Rows at the same place of both sides; the longer side is cut."""
    return left.join(right, list(keys), "inner")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order.

    The row is found by a partial aggregate, so a key with very many rows is one row per task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    return df.groupBy(*[F.col(k) for k in keys]).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by a total order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    return df.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def left_lookup(df: DataFrame, build: DataFrame, key: str, order: str) -> DataFrame:
    """Every row of ``df`` with the last row of ``build`` for its key."""
    return df.join(keep_last(build, [key], [order]), key, "left")


def unseen(df: DataFrame, seen: DataFrame, key: Column, seen_key: Column, order: Sequence[Column | str]) -> DataFrame:
    """Rows whose key isn't in ``seen``, the first of each key."""
    rows = df.withColumn("_key", key)
    fresh = rows.join(seen.select(seen_key.alias("_key")).distinct(), "_key", "left_anti")
    return keep_first(fresh, ["_key"], order).drop("_key")


def carry_over(previous: DataFrame, recomputed: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The previous rows that didn't fail and the new rows of those that did."""
    keys = list(keys)
    kept = previous.join(failed.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(recomputed.join(failed.select(*keys).distinct(), keys, "left_semi"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of its parts; the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def weighted_sample(df: DataFrame, group: Sequence[str], weight: Column, u: Column, k: int, tie: Column | str) -> DataFrame:
    """Up to k rows of each group without replacement, by weight: the smallest ``-ln(u) / weight``."""
    key = -F.ln(F.greatest(u, F.lit(1e-15))) / weight
    return top_per_group(df.withColumn("sample_key", key), group, [F.col("sample_key"), F.col(tie) if isinstance(tie, str) else tie], k)


def split_by_share(df: DataFrame, share: float, *parts: str) -> DataFrame:
    """``is_validation`` for the first ``floor(share * n)`` rows in hash order.

    Ranks come from counts of hash buckets and ranks within a bucket, so no task sorts all rows.
    """
    digest = F.md5(F.concat_ws("|", *parts))
    rows = df.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 3))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_d", *parts))
    rows = rows.withColumn("_r", rank).join(F.broadcast(sizes), "_b")  # 4096 buckets at most
    return rows.withColumn("is_validation", F.col("_before") + F.col("_r") <= F.floor(F.lit(share) * F.col("_all"))).drop("_d", "_b", "_n", "_before", "_all", "_r")


def mode_mix(u: Column, share: float = 0.85) -> Column:
    return F.when(u < share, "variant").otherwise("novel")


def capped_pool(df: DataFrame, group: Sequence[str], used: Column, cap: Column) -> DataFrame:
    """Rows used less than ``cap`` times; a group in which all are at the cap keeps all.

    Which groups have any is a partial aggregate of one row a group, not a window over its rows.
    """
    rows = df.withColumn("_free", F.coalesce(used < cap, F.lit(False)))
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    any_free = rows.groupBy(*keys).agg(F.max("_free").alias("_any"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return rows.join(any_free, on).filter("_free or not _any").select(*df.columns)


def usage_cap(n: Column | int) -> Column:
    """At least 3, else a fortieth of all."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(3), F.floor(n / 40)).cast("long")


def complement(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which a flag holds, and all others."""
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    return rows.filter("_flag").drop("_flag"), rows.filter("not _flag").drop("_flag")


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables, columns by name; a column that a table lacks is null there."""
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
