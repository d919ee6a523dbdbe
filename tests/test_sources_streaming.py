import json

from pyspark.sql import functions as F

from scenewright.operators import dataprep as dp
from scenewright.operators import metrics, slang
from scenewright.plans import evaluation, providers, story
from scenewright.sources import files
from scenewright.streaming.characters import stream_states

STORY = "सुबह राम घर से निकला।\n\nफिर वह स्कूल गया।\n\nशाम को राम बाहर गया।"


def test_text_and_jsonl_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(STORY, encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"input": "x", "target": "y"}\n\n{"input": "z", "target": "w"}\n', encoding="utf-8")
    stories = files.read_stories(spark, f"{tmp_path}/a.txt")
    assert stories.count() == 1 and stories.first()["text"] == STORY
    assert files.read_lines(spark, f"{tmp_path}/a.txt").count() == 3
    assert files.read_jsonl(spark, f"{tmp_path}/b.jsonl", "input string, target string", limit=1).count() == 1
    packed = files.pack_folder(spark, str(tmp_path))
    assert packed.count() == 2
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    assert files.pack_folder(spark, str(tmp_path)).count() == 2


def test_csv_round_trip_and_cleaning(spark, tmp_path):
    names = list(files.RAW_COLUMNS)
    (tmp_path / "raw.csv").write_text(",".join(f'"{n}"' for n in names) + '\n"kya hai","c","s","Bhai, yaar","END","yes","[assert happy]","filler","kya hai ""bhai"""\n"same","c","s","x","END","no","A","b","SAME"\n', encoding="utf-8")
    kept, aside = dp.clean_pairs(files.read_raw_pairs(spark, f"{tmp_path}/raw.csv"))
    row = kept.first()
    assert row["output"] == 'kya hai "bhai"' and row["control"] == "ASSERT_HAPPY" and aside.count() == 1
    files.write_csv(kept.drop("row_id"), f"{tmp_path}/clean")
    back = files.read_clean_pairs(spark, f"{tmp_path}/clean").first()
    assert back["slangs"] == ["Bhai", "yaar"] and back["positions"] == ["END"] and back["multi_allowed"]
    files.write_rejects([aside, kept.withColumn("more", F.lit(1))], f"{tmp_path}/rejects")
    assert spark.read.csv(f"{tmp_path}/rejects", header=True).count() == 2
    files.write_lexicon(slang.lexicon_counts(kept), f"{tmp_path}/lexicon")
    kinds = {r["key_kind"] for r in spark.read.json(f"{tmp_path}/lexicon").collect()}
    assert kinds == {"control", "function"}
    files.write_examples(dp.editor_examples(kept, ["row_id"]), f"{tmp_path}/examples")
    assert set(spark.read.json(f"{tmp_path}/examples").columns) == {"input", "target"}


def test_session_state(spark, tmp_path):
    assert files.load_state(spark, str(tmp_path), "s 1", "k") is None
    files.save_state(spark.range(3), str(tmp_path), "s 1", "k")
    files.save_state(spark.range(5), str(tmp_path), "s 1", "k")
    assert files.load_state(spark, str(tmp_path), "s 1", "k").count() == 5


def test_traces_to_report(spark, tmp_path):
    scene = lambda i, d, ev=None: {"scene_id": i, "dialogue": d, "events": ev}
    trace = {"neutral_script": [scene("scene_01", "old"), scene("scene_01", "A: kya hai", {"key_events": ["kya"]})], "slang_script": [scene("scene_01", "A: kya hai yaar"), scene("scene_02", "B: x")]}
    (tmp_path / "t.json").write_text(json.dumps(trace), encoding="utf-8")
    pairs = evaluation.scene_pairs(*files.read_traces(spark, f"{tmp_path}/t.json"))
    rows = {r["scene_id"]: r for r in pairs.collect()}
    assert rows["scene_01"]["neutral"] == "A: kya hai" and rows["scene_02"]["neutral"] == ""
    phrases = spark.createDataFrame([("yaar",)], "phrase string")
    out = evaluation.evaluate(pairs, phrases, slang.word_lexicon(phrases), F.lit(0.9))
    assert out["report"].first()["event_recall_mean"] == 0.5 and out["rollup"].first()["slang_total"] == 1


def test_providers(spark):
    lines = spark.createDataFrame([(1, "Jaldi chalo"), (2, "jaldi chalo "), (3, ""), (4, "kuch")], "i int, utterance string")
    recorded = spark.createDataFrame([("jaldi chalo", "request_urgency"), ("kuch", None)], "prompt_key string, response string")
    got = {r["i"]: r["intent"] for r in providers.classify_intents(lines, providers.replay(recorded)).collect()}
    assert got == {1: "REQUEST_URGENCY", 2: "REQUEST_URGENCY", 3: "INFORM_NEUTRAL", 4: "CASUAL_ASSERTION"}
    both = providers.failover(providers.replay(recorded), providers.rule(F.lit("EXPRESS_STRESS")))
    assert {r["i"]: r["intent"] for r in providers.classify_intents(lines, both).collect()}[4] == "EXPRESS_STRESS"


def test_event_fallbacks(spark):
    scenes = spark.createDataFrame([(1, 1, "scene_01", "a"), (1, 2, "scene_02", "b"), (1, 3, "scene_03", "c"), (1, 4, "scene_04", "d")], "story_id int, scene_idx int, scene_id string, text string")
    recorded = spark.createDataFrame([("1|scene_01", '[{"scene_id": "x", "key_events": ["e"], "characters": ["Ram"]}]'), ("1|scene_02", "[]"), ("1|scene_03", "junk")], "prompt_key string, response string")
    got = {r["scene_id"]: r for r in providers.extract_events(scenes, providers.replay(recorded)).collect()}
    assert got["scene_01"]["key_events"] == ["e"] and got["scene_02"]["narrative_link"] == "This is the first scene."
    assert got["scene_03"]["narrative_link"] == "" and got["scene_04"]["key_events"] is None and len(got) == 4


def test_story_run(spark):
    stories = spark.createDataFrame([(1, STORY), (2, "")], "story_id int, text string")
    pairs = spark.createDataFrame([("ASSERT_HAPPY", "idiom", ["mast"]), ("X", "filler", ["yaar", "bhai", "boss", "bro"])], "control string, function string, slangs array<string>")
    out = story.run(stories, pairs)
    scenes = out["scenes"].orderBy("scene_idx").collect()
    assert [r["scene_id"] for r in scenes] == ["scene_01", "scene_02", "scene_03"]
    assert all(r["slang"] and len(r["decisions"]) == 1 for r in scenes) and out["script"].count() == 1
    assert out["events"].count() == out["chunks"].count()


def test_story_run_with_an_editor(spark):
    models = story.rules()
    models.editor = providers.rule(F.concat(F.lit("Boss, "), F.regexp_extract("prompt_key", r"[^|]*$", 0)))
    pairs = spark.createDataFrame([("ASSERT_HAPPY", "idiom", ["mast"])], "control string, function string, slangs array<string>")
    scenes = story.run(spark.createDataFrame([(1, STORY)], "story_id int, text string"), pairs, models, max_attempts=1)["scenes"].collect()
    said = [d for r in scenes for d in r["decisions"]]
    assert said and all(d["slang"] is None for d in said)
    assert any("Boss," in r["slang"] for r in scenes) == any(d["applied"] for d in said)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{k}", i, ["angry", None, "happy", "sad"][(k + i) % 4]) for k in range(3) for i in range(9)]
    schema = "key string, order int, trigger string"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("states").groupBy("key").agg(F.max_by(F.struct("emotion", "stress_index"), "turn_count").alias("s"), F.max("turn_count").alias("n")).collect()
    from scenewright.operators.characters import final_states

    batch = {r["key"]: (r["emotion"], r["stress_index"], r["turn_count"]) for r in final_states(spark.createDataFrame(rows, schema), ["key"], ["order"], "trigger").collect()}
    assert {r["key"]: (r["s"]["emotion"], r["s"]["stress_index"], r["n"]) for r in last} == batch


def test_judge(spark):
    rows = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in rows.select(metrics.judge_passes("a", "b")).collect()] == [True, False, False]
