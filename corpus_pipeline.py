"""The corpus pipeline: each stage calls one operator over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm import common
from scenewright.llm import decontaminate as decontamination
from scenewright.llm import jaccard_join, line_dedup, mixing, quality_knn


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours' vote calls them good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_knn.fit(docs, labels.filter(~quality_knn.held_out()))
    return quality_knn.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; a document that has no line left goes."""
    return line_dedup.without_repeats(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights, with their topic, tokens and probability."""
    mixed = mixing.mix(docs, keep=["text", "n_chars"]).filter("sampled")
    return mixed.select(F.col("id").alias("doc_id"), "text", "lang", "source", "n_chars", "topic", "n_tokens", "probability")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: Classifier, similarity join and decontamination can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to ``documents``; stages' rows are kept in the shared checkpoint folder."""
    at = f"{common.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
