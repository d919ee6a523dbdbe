"""The vote against a plain one: every cosine in float64, all labelled vectors sorted."""

import math

import numpy as np
import pyarrow.parquet as pq

from scenewright.llm import quality_knn as q

SF = "/root/testdata/sf0.01"


def plain_vote(model, row):
    cos = [math.fsum(float(a) * float(b) for a, b in zip(row, v)) for v in model.vectors]
    near = sorted(range(len(cos)), key=lambda i: -cos[i])[: q.NEIGHBOURS]
    w = [max(cos[i], 0.0) ** q.POWER for i in near]
    return sum(x * float(model.labels[i]) for x, i in zip(w, near)) / sum(w) if sum(w) > 1e-12 else float(model.labels.mean())


def test_scores_equal_a_plain_vote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    model = q.fit(docs, truth.filter(~q.held_out()))
    got = {r["id"]: r["score"] for r in q.score(docs, model).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()[::25] + [{"doc_id": None, "text": ""}]
    terms = q.Terms()
    vectors = model.embed(terms.counts([(r["text"] or "").encode() for r in rows])).astype(np.float64)
    for r, v in zip(rows, vectors):
        want = plain_vote(model, v.tolist())
        if r["doc_id"] is None:
            assert abs(want - model.labels.mean()) < 1e-6
        else:
            assert abs(got[r["doc_id"]] - want) < 1e-5


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scores = lambda t: {r["id"]: round(r["score"], 5) for r in q.classify(docs, t).collect()}
    from pyspark.sql import functions as F

    turned = truth.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(truth) == scores(turned)
