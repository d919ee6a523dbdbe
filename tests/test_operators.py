import random

from pyspark.sql import functions as F

from scenewright.functions import lexicons as lx
from scenewright.functions.similarity import best_window_ratio
from scenewright.operators import augment
from scenewright.operators import characters as ch
from scenewright.operators import dataprep as dp
from scenewright.operators import gates, metrics, relational, scenes, slang
from scenewright.plans import augment as plans_augment
from scenewright.plans import catalogue
from scenewright.plans import providers as pv


def test_scene_chunks(spark):
    text = "subah ram ghar se nikla.\n\nphir woh school gaya aur apne dost se mila.\n\n \n\n"
    rows = scenes.scene_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "story_id int, text string")).orderBy("scene_idx").collect()
    assert [(r["scene_id"], r["has_location_cue"], r["has_temporal_cue"]) for r in rows] == [("scene_01", True, True), ("scene_02", True, True)]
    many = spark.createDataFrame([(1, "\n\n".join("x" * 105))], "story_id int, text string")
    assert {r["scene_id"] for r in scenes.scene_chunks(many).collect()} >= {"scene_09", "scene_100", "scene_105"}


def gate_rows(spark, rows):
    schema = "s int, line_idx long, speaker string, social_role string, slang_level int, intent string, tokens long, added long"
    out = gates.gate_lines(spark.createDataFrame(rows, schema), ["s"]).orderBy("line_idx").collect()
    return [(r["go"], r["gate_stopped"], r["intent"]) for r in out]


def test_gates(spark):
    casual = "CASUAL_ASSERTION"
    assert gate_rows(spark, [(1, 0, "a", "elder", 0, casual, 3, 1), (1, 1, "b", "authority", 0, casual, 3, 1), (1, 2, "c", "peer", 0, casual, 3, 1)]) == [(False, 1, None)] * 3
    assert gate_rows(spark, [(1, 0, "a", None, None, "INFORM_NEUTRAL", 3, 1)]) == [(False, 2, "INFORM_NEUTRAL")]
    # 0 of 10, then 5 of 20: a quarter is full.
    assert gate_rows(spark, [(1, 0, "a", "peer", 5, casual, 10, 5), (1, 1, "a", "peer", 5, casual, 10, 5)]) == [(True, None, casual), (False, 3, casual)]
    assert gate_rows(spark, [(1, 0, "a", "peer", 5, casual, 0, 0)]) == [(True, None, casual)]


def test_density_fold_equals_plain_loop(spark):
    r = random.Random(1)
    rows = [(s, i, "a", r.choice(["peer", "elder"]), 5, r.choice(["CASUAL_ASSERTION", "INFORM_NEUTRAL"]), r.randint(0, 9), r.randint(0, 4)) for s in range(20) for i in range(15)]
    schema = "s int, line_idx long, speaker string, social_role string, slang_level int, intent string, tokens long, added long"
    got = {(x["s"], x["line_idx"]): x["gate_stopped"] for x in gates.gate_lines(spark.createDataFrame(rows, schema), ["s"]).collect()}
    seen = set()
    for s in range(20):
        total = used = 0
        for _, i, _, role, _, intent, tokens, added in [x for x in rows if x[0] == s]:
            want = 1 if role == "elder" else 2 if intent == "INFORM_NEUTRAL" else None
            if want is None:
                total += tokens
                if total and used / total >= 0.25:
                    want = 3
                else:
                    used += added
            assert got[s, i] == want
            seen.add(want)
    assert seen == {None, 1, 2, 3}


def test_mood_fold_equals_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(ch, "CHUNK", 7)
    r = random.Random(2)
    rows = [(k, i, r.choice([None, None, "angry", "happy", "sad", "urgent"])) for k in range(12) for i in range(r.randint(1, 60))]
    got = {x["k"]: (x["emotion"], x["turn_count"], x["stress_index"]) for x in ch.final_states(spark.createDataFrame(rows, "k int, i int, t string"), ["k"], ["i"], "t").collect()}
    for k in range(12):
        mood, turns, stress = "neutral", 0, 0.0
        for _, _, t in [x for x in rows if x[0] == k]:
            mood, turns = t or mood, turns + 1
            step = lx.STRESS_TENTHS.get(mood, 0) / 10
            stress = round(min(1.0, max(0.0, stress + step)), 3)
        assert got[k] == (mood, turns, stress)


def test_roles_and_moods(spark):
    row = spark.createDataFrame([("Dadaji aur doctor", "usne gussa kiya, khush tha")], "a string, b string")
    got = row.select(ch.social_role("a").alias("r"), ch.triggered_emotion("b").alias("e"), ch.social_role(F.lit("xyz")).alias("p")).first()
    assert tuple(got) == ("elder", "angry", "peer")


def test_structural_check(spark):
    rows = [
        (1, "kya kar rahe ho", "bhai kya kar rahe ho", "bhai"), (2, "kya kar rahe ho", "Bhai, kya kar rahe ho!", "bhai"), (3, "", "x", "x"), (4, "नमस्ते", "x", "x"),
        (5, "aaj ka din accha", "aaj ka din", "mast"), (6, "same line here now", "SAME line here now", "line"), (7, "do shabd", "do shabd yaar", "yaar"),
        (8, "main ghar ja raha hun", "yaar bilkul alag baat", "yaar"), (9, "yeh purana hai na", "purana yaar", "yaar"),
    ]
    seen = spark.createDataFrame([("Purana, yaar!", "y")], "output string, neutral string")
    got = {r["i"]: r["reason"] for r in dp.structural_check(spark.createDataFrame(rows, "i int, neutral string, output string, slang string"), seen, ["i"]).collect()}
    assert got == {1: "ok", 2: "duplicate", 3: "empty", 4: "devanagari", 5: "slang_absent", 6: "no_change", 7: "length", 8: "semantic_drift", 9: "duplicate"}


def test_without_slang_takes_the_slang_literally(spark):
    row = spark.createDataFrame([("Arre (yaar)+ chalo, (YAAR)+!", "(yaar)+")], "o string, s string").select(dp.without_slang("o", "s")).first()[0]
    assert row == "Arre chalo"


def test_fuzzy_presence(spark):
    rows = spark.createDataFrame([(1, ["jhakaas"], "ekdam jakaas hai"), (2, ["mast"], "kuch nahi"), (3, [], "x"), (4, ["Patti padhana"], "patti padha raha")], "i int, s array<string>, o string")
    assert {r["i"]: r["slang_present"] for r in dp.fuzzy_present(rows, "s", "o").collect()} == {1: True, 2: False, 3: False, 4: True}


def test_keep_first_and_split(spark):
    rows = spark.range(1000).withColumn("input", (F.col("id") % 300).cast("string")).withColumn("target", F.lit("t"))
    first = relational.keep_first(rows, ["input", "target"], ["id"])
    assert first.agg(F.max("id"), F.count("*")).first()[:] == (299, 300)
    split = relational.split_by_share(first, 0.08, "input", "target")
    assert split.filter("is_validation").count() == 24


def test_weighted_sample_prefers_weight(spark):
    rows = spark.range(4000).select((F.col("id") % 400).alias("g"), "id", F.when(F.col("id") % 10 == 0, 20.0).otherwise(1.0).alias("w"))
    got = relational.weighted_sample(rows, ["g"], F.col("w"), relational.unit_hash("id"), 2, "id")
    assert got.count() == 800 and got.select("id").distinct().count() == 800
    heavy = got.filter("w > 1").count()
    assert heavy == 80  # every group holds either heavy rows only or none


def test_usage_fold_avoids_repeats(spark):
    rows = spark.createDataFrame([(s, i, ["a", "b", "c", "d"]) for s in range(3) for i in range(40)], "story int, line int, pool array<string>")
    got = slang.usage_fold(rows, "story", ["line"], k=3).orderBy("story", "line").collect()
    again = sum(a["taken"] == b["taken"] for a, b in zip(got, got[1:]) if a["story"] == b["story"])
    assert again < 12 and all(len(set(r["candidates"])) == 3 for r in got)


def test_events(spark):
    row = spark.createDataFrame([("Yaar mujhe ek diary mili library mein", ["Arav finds a diary", "in the library", "the of"]), (None, None)], "d string, e array<string>")
    assert [tuple(r["c"]) for r in row.select(metrics.covered_events("d", "e").alias("c")).collect()] == [(2, 3, 2 / 3), (0, 0, 0.0)]


def test_detect_slang(spark):
    p = spark.createDataFrame([(1, "kya hai", "A: scene hai kya\nB: mast mast yaar"), (2, None, None)], "i int, neutral string, slang string")
    phrases = spark.createDataFrame([("scene hai",), ("mast",), ("yaar",)], "phrase string")
    rows = {r["i"]: r for r in metrics.scene_metrics(metrics.detect_slang(p, phrases, slang.word_lexicon(phrases))).collect()}
    assert rows[1]["detected"] == ["scene hai", "mast", "mast", "yaar"] and rows[1]["coverage"] == 1.0
    assert rows[2]["detected"] == [] and rows[2]["validity"] == 1.0 and rows[2]["n_lines"] == 0
    assert metrics.top_slang(metrics.detect_slang(p, phrases, slang.word_lexicon(phrases))).first()["term"] == "mast"


def test_carry_over(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    got = relational.carry_over(old, old.withColumn("v", F.lit("new")), old.filter("i = 2"), ["i"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "new")]


def test_fuzzy_query_compares_whole_texts(spark, tmp_path):
    texts = ["the same start, then apples", "the same start, but pears and plums"]
    spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.q43_fuzzy(spark, str(tmp_path)).collect()
    assert [(r["item_id"], r["partial"]) for r in got] == [(1, round(best_window_ratio(*texts), 4))] and got[0]["partial"] < 100


def test_usage_fold_carries_over_batches_and_stories(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(s, i, ["a", "b"]) for s in ("x", "y", None) for i in range(30)], "story string, line int, pool array<string>")
        got = slang.usage_fold(rows, "story", ["line"], k=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 90
    for story in ("x", "y", None):
        taken = [r["taken"] for r in sorted(got, key=lambda r: r["line"]) if r["story"] == story]
        assert len(taken) == 30 and abs(taken.count("a") - taken.count("b")) <= 8
    empty = spark.createDataFrame([("z", 1, None), ("z", 2, [])], "story string, line int, pool array<string>")
    assert [(r["candidates"], r["taken"]) for r in slang.usage_fold(empty, "story", ["line"]).collect()] == [([], None)] * 2


def test_draws_follow_weights(spark):
    pairs = spark.createDataFrame([(" a ", ["x", " y "]), ("A", ["x"]), (None, ["x", "z"])], "control string, slangs array<string>")
    items = {(r["control"], r["slang"]): r["freq"] for r in augment.lexicon_items(pairs).collect()}
    assert items == {("A", "x"): 3, ("A", "y"): 1}
    used = spark.createDataFrame([("y", 9)], "slang string, used long")
    pools = augment.draw_pools(augment.lexicon_items(pairs), used, 3)
    drawn = augment.draw_slang(spark.createDataFrame([(1, "A"), (2, "other")], "i int, control string"), pools, ["i"])
    assert {r["i"]: r["slang"] for r in drawn.collect()} == {1: "x", 2: "x"}
    pools = augment.draw_pools(augment.lexicon_items(pairs), spark.createDataFrame([("y", 1)], "slang string, used long"))
    drawn = augment.draw_slang(spark.range(4000).withColumn("control", F.lit("A")), pools, ["id"])
    share = drawn.filter("slang = 'x'").count() / 4000
    want = (1 / 1.3) / (1 / 1.3 + 1 / 4.1)
    assert abs(share - want) < 0.03
    none = augment.draw_slang(spark.range(2).withColumn("control", F.lit("A")), pools.limit(0), ["id"])
    assert [r["slang"] for r in none.collect()] == [None, None]


def test_generate_keeps_what_is_wanted(spark):
    lines = [(i, f"line number {i} goes here", f"yaar line {i} went elsewhere", "ASSERT_HAPPY", ["yaar", "mast", f"s{i % 9}"]) for i in range(60)]
    pairs = spark.createDataFrame(lines, "i int, neutral string, output string, control string, slangs array<string>")
    line = F.coalesce("neutral", F.concat(F.lit("a new line about "), "context", F.lit(" no "), F.col("i")))
    answer = F.to_json(F.struct(line.alias("neutral"), F.concat("slang", F.lit(" "), line).alias("output")))
    judge = pv.rule(F.to_json(F.struct(*[(F.col("i") % 5 != 0).alias(v) for v in augment.VERDICTS])))
    kept, aside = plans_augment.generate(pairs, ["i"], 30, pv.rule(answer), judge, min_ratio=40.0)
    rows = kept.collect()
    assert len(rows) == 30 and len({r["output"] for r in rows}) == 30
    assert all(r["slang"] in r["output"] and r["i"] % 5 for r in rows)
    assert "judge_reject" in {r["reason"] for r in aside.collect()}
    novel = [r["neutral"] for r in rows if r["mode"] == "novel"]
    assert len(novel) == len(set(novel))
    few, _ = plans_augment.generate(pairs.limit(0), ["i"], 5, pv.rule(answer), judge, rounds=1)
    assert few.count() == 0


def test_repeats_of_a_batch_by_output_and_new_line(spark):
    rows = [(i, "yeh ek nayi line hai", f"yaar yeh ek nayi line hai {i % 3}", "yaar", i >= 50) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, neutral string, output string, slang string, fresh boolean")
    got = dp.structural_check(df, df.limit(0), ["i"], novel=F.col("fresh"), min_ratio=None).filter("reason = 'ok'").collect()
    assert sorted(r["i"] for r in got) == [0, 1, 2]
    alone = dp.structural_check(df.filter("fresh"), df.limit(0), ["i"], novel=True, min_ratio=None).filter("reason = 'ok'").collect()
    assert [r["i"] for r in alone] == [50]


def test_editor_lines(spark):
    rows = spark.createDataFrame([(1, "kya hai", "EXPRESS_STRESS"), (2, "Theek", "other"), (3, "chup", None), (4, None, "ASSERT_POSITIVE")], "i int, utterance string, intent string")
    reply = F.when(F.contains("prompt_key", F.lit("kya")), F.concat(F.lit("Yaar, "), "prompt_key", F.lit(" yaar!"))).when(F.contains("prompt_key", F.lit("Theek")), "THEEK")
    got = {r["i"]: r["new"] for r in pv.edit_lines(rows, pv.rule(reply)).collect()}
    assert got == {1: "Yaar, insert slang | control: ASSERT_STRESS | kya hai", 2: "Theek", 3: "chup", 4: None}
