"""Nulls, empty and repeated rows, empty tables, clashing names: a defined result for each operator."""

import hashlib
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenewright.llm import decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, mixing, ngram_lm, quality_knn, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "First line of a shared passage here.\nSecond line of the passage.\nThird line ends it all.\n"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0),
    (None, "alpha beta gamma delta epsilon zeta", "en", None, 5), (4, "word " * 30_000, "de", "s", 150_000), (5, " \n\t ", None, "t", 4), (6, LINES + "own six", "en", "s", 1), (7, "own seven. " + LINES, "en", "s", 1),
]
CLASHING = "id node shard version row own gone text_md5 _salt _d hash place clean n_lines removed_lines label score _score topic n_tokens weight probability sampled length prefix full".split()


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta"), (1, None), (2, "")], "item_id long, text string")


SPEC = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
OPERATORS = {
    "lm": lambda s, d: ngram_lm.lm_scores(d),
    "lines": lambda s, d: line_dedup.line_dedup(d),
    "quality": lambda s, d: quality_knn.classify(d, labels(s)),
    "mix": lambda s, d: mixing.mix(d),
    "tokens": lambda s, d: token_counts.token_counts(d, SPEC),
    "jaccard": lambda s, d: jaccard_join.jaccard_components(d),
    "licences": lambda s, d: license_scan.license_scan(d),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    got = OPERATORS[name](spark, table(spark)).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


def test_pass_through_operators_keep_the_columns(spark):
    docs = table(spark)
    clean = line_dedup.without_repeats(docs, length_col="n_chars")
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[6]["text"] == LINES + "own six" and texts[7]["text"] == "own seven. " and texts[7]["n_chars"] == 11
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "2", "3", "4", "5", "6", "7"]
    kept = decontaminate.decontaminate(docs, bench(spark))
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "3", "4", "5", "6", "7"]
    model = quality_knn.fit(docs, labels(spark))
    good = quality_knn.accepted(docs, model)
    assert good.columns == docs.columns and 0 < good.count() <= len(ROWS)


def test_line_dedup_defined_cases(spark):
    def removed(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r["removed_lines"] for r in line_dedup.line_dedup(df).orderBy("id").collect()]

    abc = "A line of text here\nB line of text here\nC line of text here"
    assert removed(abc, abc) == [[], [0, 1, 2]]
    assert removed(abc, "x\n" + abc + "\ny") == [[], [1, 2, 3]]
    assert removed("A line of text here\nB line of text here", "A line of text here\nB line of text here") == [[], []]
    same = "\n".join(["the same line again and again"] * 5)
    assert removed(same) == [[1, 2, 3, 4]]
    assert removed("a.\nb.\nc.", "a.\nb.\nc.") == [[], [0, 1, 2]]
    assert removed(abc.replace("\n", " . "), None)[1] == []


def test_exact_dedup_defined_cases(spark):
    rows = [(5, "a b"), (3, "ab"), (4, " a\tb "), (9, None), (8, " "), (7, "x")]
    got = {r["id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["keep_id"] for i in (3, 4, 5)] == [4, 4, 4] and got[4]["group_size"] == 3
    assert got[9]["keep_id"] == 8 and got[8]["kept"] and not got[9]["kept"]
    assert bytes(got[7]["full"]) == hashlib.sha256(b"x").digest()


def test_token_counts_equal_the_library(spark):
    r = random.Random(4)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    alphabet = "abcdeést'rvmlld 0123 ½Ⅷ²!?.-<|>ΣσςİßÀ́\u0085 ​日本語कखि'"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(1500)] + ["<|endoftext|>a<|startoftext|>", "a" * 5000, "I'M they'RE '''s"]
    texts += [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Compiled(SPEC).count(texts).tolist() == want


def test_other_tokenizer_files_are_refused(spark):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        other = f.read()
    with pytest.raises(ValueError, match="normalizer"):
        token_counts.token_counts(table(spark), other)


def test_split_chunks_compose():
    import numpy as np

    nxt, _ = token_counts.splitter()
    c = np.random.default_rng(1).integers(0, 6, 64 * 20).astype(np.uint8)
    chunks = np.ascontiguousarray(c.reshape(20, 64).T)
    state, want = 0, []
    for chunk in c.reshape(20, 64):
        want.append(state)
        for x in chunk:
            state = nxt[state, x]
    assert token_counts.entry_states(chunks, nxt).tolist() == want


def test_warc_round_trip_with_magic_inside(spark):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nxxxxx\r\n\r\n"
    long = "é" * 700
    pages = [(1, "http://a", magic + "tail"), (2, None, None), (3, "http://b\r\nX: y", ""), (4, "u", long), (5, "u", long), (6, "u", "short"), (7, "u", "short"), (None, "u", "none"), (8, "u", magic * 3), (9, "u", "a\r\n\r\nb\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {r["id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert got[i]["record_type"] == ("revisit" if i == 4 else "response") and got[i]["refers_to"] == (5 if i == 4 else None)
    path = warc.archive_dir(spark)
    warc.write_warc(df, path)
    heads = {re.search(r"urn:pages:(\d*)", r["header"])[1]: r["header"] for r in warc.read_warc(spark, path).collect()}
    assert [k for k, h in heads.items() if f"WARC-Profile: {warc.PROFILE}" in h] == ["4"]
    payloads = {re.search(r"urn:pages:(\d*)", r["header"])[1]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, path).collect()}
    assert payloads["8"] == magic * 3 and payloads["1"] == magic + "tail" and payloads["4"] == ""
    assert warc.round_trip(df.filter("false")).count() == 0


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, keep_share=0.02).collect()
    for dim, share in (("topic", lambda k: None), ("lang", None)):
        got, weight = {}, {}
        for r in rows:
            got[r[dim]] = got.get(r[dim], 0) + r["n_tokens"] * r["probability"]
            weight[r[dim]] = weight.get(r[dim], 0) + r["n_tokens"]
        total = sum(got.values())
        power = 0.0 if dim == "topic" else 0.5
        norm = sum(w**power for w in weight.values())
        for k, w in weight.items():
            assert abs(got[k] / total - w**power / norm) < 0.02, (dim, k)


def test_mix_makes_up_for_cells_that_run_out(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), keep_share=0.5).collect()
    assert sum(r["probability"] == 1 for r in rows) > 20
    all_tokens = sum(r["n_tokens"] for r in rows)
    for dim, power in (("source", 0.5), ("lang", 0.5), ("topic", 0.0)):
        got, there = {}, {}
        for r in rows:
            got[r[dim]] = got.get(r[dim], 0) + r["n_tokens"] * r["probability"]
            there[r[dim]] = there.get(r[dim], 0) + r["n_tokens"]
        norm = sum(w**power for w in there.values())
        for k, w in there.items():
            assert abs(got[k] / (0.5 * all_tokens) - w**power / norm) < 1e-4, (dim, k)


def test_mix_with_targets_that_cannot_be_met(spark):
    text = lambda n: " ".join(["word"] * n)
    df = spark.createDataFrame([(i, text(5), "en", "s", "a" if i < 5 else "b") for i in range(100)], "doc_id long, text string, lang string, source string, kind string")
    rows = mixing.mix(df, keep_share=0.5, topic=F.col("kind")).collect()
    # "a" should give a quarter of all tokens and has a twentieth; "b" gives its own quarter.
    assert {(r["topic"], round(r["probability"], 6)) for r in rows} == {("a", 1.0), ("b", round(25 / 95, 6))}
    assert {r["probability"] for r in mixing.mix(df, keep_share=0.0).collect()} == {0.0}


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = quality_knn.classify(docs, truth).join(truth.withColumnRenamed("doc_id", "id"), "id").filter(quality_knn.held_out("id"))
    r = scored.select(((F.col("score") >= 0.5).cast("int") == F.col("quality")).alias("ok")).agg(F.avg(F.col("ok").cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 1000 and r["a"] > 0.97
