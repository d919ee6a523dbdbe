"""What the operator does in defined cases."""

from scenewright.llm import line_dedup


def removed(spark, *texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["removed_lines"] for r in line_dedup.line_dedup(df, **kw).orderBy("id").collect()]


def test_short_windows_count_but_below_a_floor(spark):
    short = "Of.\nOf.\nTo."
    assert removed(spark, short, "x.\n" + short, min_chars=40) == [[], []]
    assert removed(spark, short, "x.\n" + short) == [[], [1, 2, 3]]
    docs = spark.createDataFrame([(0, short), (1, short), (2, "own\n" + short)], "doc_id long, text string")
    clean = line_dedup.without_repeats(docs)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {0: short, 2: "own\n"}


def test_every_line_of_a_later_occurrence_goes(spark):
    a, b, c, d, e = (f"Line {x} is long enough here" for x in "ABCDE")
    texts = ["\n".join(x) for x in ([a, b, c], [d, a, b, c, e], [d, a, b, c, e])]
    # Document 1 repeats a, b, c of document 0, and is the first to hold d, a, b and b, c, e.
    assert removed(spark, *texts) == [[], [1, 2, 3], [0, 1, 2, 3, 4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()}
    assert clean == {0: texts[0], 1: d + "\n" + e}


def test_hot_windows_are_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 3)
    hot = "One line.\nTwo lines.\nThree lines.\n"
    texts = [hot * 3, *[f"Own {k}.\n" + hot for k in range(12)], "Rare a.\nRare b.\nRare c.", "x.\nRare a.\nRare b.\nRare c."]
    assert removed(spark, *texts) == [[3, 4, 5, 6, 7, 8], *[[1, 2, 3]] * 12, [], [1, 2, 3]]


def test_rows_that_share_an_id_but_not_a_text_keep_apart(spark):
    passage = "A line here.\nB line here.\nC line here."
    df = spark.createDataFrame([(1, passage), (1, "x.\n" + passage), (1, "x.\n" + passage)], "doc_id long, text string")
    got = [r["removed_lines"] for r in line_dedup.line_dedup(df).collect()]
    assert sorted(got) in ([[], [1, 2, 3], [1, 2, 3]], [[], [], [0, 1, 2]])
