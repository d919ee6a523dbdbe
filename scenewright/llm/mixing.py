"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells of source, language and topic. Raking scales the cells'
token weights in turn until they meet the target tokens of every source, language and
topic. A cell can't give more tokens than it has: each step cuts its weight there, and the
steps after it make up for that in other cells. A document is then kept with its cell's
calibrated probability: weight over tokens. Which documents are kept is decided by a hash
of the id, so a run can be repeated.

Cells are summed before the exchange, so a source with a third of all rows is one row per
task. The table of cells grows with the number of combinations, not with the documents; it
is raked in one task while it is small enough, and over the session's partitions beyond.
Probabilities are brought to the documents by a salted join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checkpointed, salt, with_salts

#: Sweeps over the dimensions, and those after which the lineage is cut.
SWEEPS, CUT_EVERY = 12, 6
#: Cells that one task rakes.
ONE_TASK_CELLS = 200_000
SALTS = 16
#: Topics, and the share of all tokens that a mix keeps by default.
TOPICS, KEEP_SHARE = 8, 0.5


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A stand-in for a topic model: a bucket of the text's longest word, the last in order of ties."""
    words = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    return F.conv(F.substring(F.md5(longest.cast("binary")), 1, 8), 16, 10).cast("long") % topics


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**12))


def damped_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Targets of a dimension: its token shares to the given power, normalised (0: equal shares)."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    sums = sums.withColumn("p", F.pow(F.col("t").cast("double"), F.lit(float(power))))
    whole = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(dim, (F.col("p") / F.lit(whole)).alias(f"target_{dim}"))


def rake(cells: DataFrame, dims: list[str], budget: float, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dims, tokens, target_dim...) with ``weight``: the tokens to keep, ``budget`` in all, that meet the targets.

    Cells without tokens keep weight 0, and no cell's weight exceeds its tokens. Where the
    targets can't all be met, because combinations have too few tokens, what is missing
    stays missing; of the rest, the last dimension is the nearest to its targets.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for sweep in range(sweeps):
        for dim in dims:
            total = F.sum("weight").over(W.partitionBy(dim))
            scaled = F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"target_{dim}") * F.lit(float(budget)) / total)
            out = out.withColumn("weight", F.when(total > 0, scaled).otherwise(F.lit(0.0)))
        if (sweep + 1) % CUT_EVERY == 0:
            out = checkpointed(out)
    return out


def probabilities(cells: DataFrame, dims: list[str], powers: Mapping[str, float], keep_share: float, sweeps: int = SWEEPS) -> DataFrame:
    """dims, weight, probability of each cell; the expected kept tokens are ``keep_share`` of all, less only where the targets can't be met."""
    for dim in dims:
        cells = cells.join(damped_targets(cells, dim, powers[dim]).withColumnRenamed(dim, "_d"), F.col(dim).eqNullSafe(F.col("_d")), "left").drop("_d")
    cells = checkpointed(cells)
    if cells.count() <= ONE_TASK_CELLS:
        cells = cells.coalesce(1)
    budget = float(cells.agg(F.sum("tokens")).first()[0] or 0) * keep_share
    raked = rake(cells, dims, budget, sweeps)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(F.lit(0.0))
    share = F.col("weight") / F.lit(budget) if budget else F.lit(0.0)
    return raked.select(*dims, share.alias("weight"), p.alias("probability"))


def mix(docs: DataFrame, powers: Mapping[str, float] | None = None, keep_share: float = KEEP_SHARE, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, topic: Column | None = None) -> DataFrame:
    """``id, source, lang, topic, n_tokens, weight, probability, sampled`` and ``keep`` of every row.

    ``topic`` is a column expression; by default the bucket of the text's longest word.
    ``powers`` damp each marginal's token shares into its target (source and lang 0.5,
    topic 0 by default). A null source or language is a value of its own. Texts without
    words have probability 0. Rows that repeat an id are kept or left together where
    their cells agree. An empty table gives an empty result.
    """
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.0} | dict(powers or {})
    dims = ["source", "lang", "topic"]
    keep = keep or []
    rows = docs.select(
        F.col(id_col).alias("id"), F.col("source"), F.col("lang"), (topic_of(F.col(text_col)) if topic is None else topic).alias("topic"), n_tokens(F.col(text_col)).alias("n_tokens"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    cells = checkpointed(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    p = probabilities(cells, dims, powers, keep_share)
    p = with_salts(p.select(*[F.col(d).alias(f"_{d}") for d in dims], "weight", "probability"), SALTS)
    on = F.col("_row_salt") == F.col("_salt")
    for d in dims:
        on = on & F.col(d).eqNullSafe(F.col(f"_{d}"))
    out = rows.withColumn("_row_salt", salt("id", salts=SALTS)).join(p, on)
    sampled = (F.col("n_tokens") > 0) & (uniform(F.col("id"), seed) < F.col("probability"))
    return out.select("id", *dims, "n_tokens", "weight", "probability", sampled.alias("sampled"), *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in (*dims, "n_tokens")])
