"""The registered queries of this subpackage: callables and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("full")).alias("text_sha256")
    )


ORACLE_SQL["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY c DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


ORACLE_SQL["op9_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), m AS (
  SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS best
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM m
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    counts = token_counts(table(spark, sf_dir, "documents"), spec)
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import classify, held_out

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed_lines").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE_SQL["op3_line_dedup"] = r"""
WITH p AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents
), q AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM p
), t AS (
  SELECT *, regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM q
), l AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM t WHERE line <> ''
), w AS (
  SELECT doc_id, place, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY place)
), r AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS k
  FROM w WHERE c IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest([place, place + 1, place + 2]) AS place FROM r WHERE k > 1
), s AS (
  SELECT t.doc_id, coalesce(string_agg(t.part, '' ORDER BY t.i) FILTER (WHERE g.place IS NULL), '') AS clean,
         count(l.place) AS n_lines, count(g.place) AS n_removed
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id AND l.i = t.i LEFT JOIN g ON g.doc_id = t.doc_id AND g.place = l.place
  GROUP BY t.doc_id
)
SELECT doc_id, n_lines, n_removed, md5(clean) AS text_md5 FROM s
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def mixing_sql(documents: str, sweeps: int = 12) -> str:
    """The mix in SQL: one step per sweep and dimension."""
    steps, last = [], "r0"
    for i in range(sweeps):
        for dim in ("source", "lang", "topic"):
            new = f"r{len(steps) + 1}"
            steps.append(f"{new} AS (SELECT * REPLACE (least(tokens, weight * t_{dim} * budget / sum(weight) OVER (PARTITION BY {dim})) AS weight) FROM {last})")
            last = new
    return rf"""
WITH d AS (
  SELECT doc_id, source, lang, len(list_filter(w, lambda x: x <> '')) AS n_tokens,
         ('0x' || substr(md5(list_max(list_transform(w, lambda x: {{'n': length(x), 'w': x}})).w), 1, 8))::BIGINT % 8 AS topic
  FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '[ 	-
]+') AS w FROM {documents})
), c AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL
), ts AS (SELECT source, pow(sum(tokens), 0.5) / sum(pow(sum(tokens), 0.5)) OVER () AS t_source FROM c GROUP BY source
), tl AS (SELECT lang, pow(sum(tokens), 0.5) / sum(pow(sum(tokens), 0.5)) OVER () AS t_lang FROM c GROUP BY lang
), tt AS (SELECT topic, 1.0::DOUBLE / count(*) OVER () AS t_topic FROM c GROUP BY topic
), r0 AS (
  SELECT c.*, tokens AS weight, (SELECT sum(tokens) FROM c) * 0.5 AS budget, t_source, t_lang, t_topic FROM c
  JOIN ts ON c.source IS NOT DISTINCT FROM ts.source JOIN tl ON c.lang IS NOT DISTINCT FROM tl.lang JOIN tt USING (topic)
), {", ".join(steps)}, p AS (
  SELECT source, lang, topic, least(1.0, weight / tokens) AS p FROM {last}
)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability,
       n_tokens > 0 AND ('0x' || substr(md5('1:' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < p AS sampled
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
"""


ORACLE_SQL["op5_mixing"] = mixing_sql("documents")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
