"""Each stage of the pipeline against a plain version of what it decides."""

import re

import corpus_pipeline as cp
from scenewright.llm import decontaminate as d
from scenewright.llm import mixing, quality_knn
from test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def plain_lines(docs):
    """doc_id -> text without later occurrences of three-line windows; None where no line is left."""
    lines, later = {}, {}
    for i in sorted(docs):
        parts = re.split(r"(?<=\n)|(?<=[.!?] )", docs[i] or "")
        own = [(k, p.strip(" \t\n\x0b\x0c\r")) for k, p in enumerate(parts)]
        lines[i] = parts, [x for x in own if x[1]]
    seen = set()
    for i in sorted(docs):
        own = lines[i][1]
        for k in range(len(own) - 2):
            w = tuple(x[1] for x in own[k : k + 3])
            if w in seen:
                later.setdefault(i, set()).update(range(k, k + 3))
            seen.add(w)
    out = {}
    for i in docs:
        parts, own = lines[i]
        gone = later.get(i, set())
        cut = {own[k][0] for k in gone}
        if gone and len(gone) == len(own):
            continue
        out[i] = "".join(p for k, p in enumerate(parts) if k not in cut) if gone else docs[i]
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontaminate", "mixture"]

    def run(name, rows):
        stages[name](spark, rows, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixture":
            assert out.columns == docs.columns
        return out

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    good = run("quality", docs)
    scored = quality_knn.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts(good)) == {r["id"] for r in scored.collect() if r["score"] >= 0.5}
    clean = run("lines", good)
    assert texts(clean) == plain_lines(texts(good))
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    one = run("near_duplicates", clean)
    groups = brute(sorted(texts(clean).items()))
    assert set(texts(one)) == {i for i, (n, c) in groups.items() if i == c}
    apart = run("decontaminate", one)
    table = d.Table([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    memo = d.WordHashes()
    assert set(texts(apart)) == {i for i, t in texts(one).items() if not list(table.overlaps(memo.of(d.tokens_of(t))))}
    last = run("mixture", apart)
    mixed = mixing.mix(apart).collect()
    assert set(texts(last)) == {r["id"] for r in mixed if r["sampled"]} and 0 < last.count() < apart.count()
    assert cp.run(spark, SF).count() == last.count()
