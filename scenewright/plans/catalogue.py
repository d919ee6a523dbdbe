"""The registered queries over the driver's tables, each with its oracle in DuckDB's SQL.

Documents stand for stories, conversations for dialogue (conversation: scene, turn: line,
role: speaker), a user turn and the assistant turn after it for a neutral line and its
slang version, benchmark texts for events, events for what moves a character's mood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.transliterate import transliterate
from ..operators import augment
from ..operators import characters as ch
from ..operators import dataprep as dp
from ..operators import gates, metrics, relational, scenes, slang
from . import evaluation, story
from . import providers as pv

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, neutral, slang."""
    c = t(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("neutral"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("slang"))
    return u.join(a, ["conv_id", "turn"])


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, coalesce(u.text, '') AS neutral, coalesce(a.text, '') AS slang
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z]+')"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_any(low: str, cues) -> str:
    return "(" + " OR ".join(f"contains({low}, '{c}')" for c in cues) + ")"


def sql_cmi(w: str) -> str:
    """cmi, en_ratio, hi_ratio of a list of words."""
    n, en = f"len({w})", f"len(list_filter({w}, lambda x: x IN {sql_in(lx.ENGLISH_WORDS)}))"
    return f"""CASE WHEN {n} > 0 THEN round(100.0::DOUBLE * ({n} - greatest({en}, {n} - {en})) / greatest({n}, 1), 2) ELSE 0.0 END AS cmi,
  CASE WHEN {n} > 0 THEN round({en}::DOUBLE / greatest({n}, 1), 3) ELSE 0.0 END AS en_ratio,
  CASE WHEN {n} > 0 THEN round(({n} - {en})::DOUBLE / greatest({n}, 1), 3) ELSE 0.0 END AS hi_ratio"""


# ---- scenes and text -------------------------------------------------------

PLACES, TIMES = ["ghar", "thor", "heit", "ciud"], ["kal", "tion", "que "]


@query(f"""
WITH p AS (
  SELECT doc_id AS story_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {sql_strip("x")}), lambda x: x <> '') AS ps FROM documents
), e AS (SELECT story_id, unnest(ps) AS text, unnest(range(1, len(ps) + 1)) AS scene_idx FROM p)
SELECT story_id, scene_idx, printf('scene_%02d', scene_idx) AS scene_id, text,
       {sql_any("lower(text)", PLACES)} AS has_location_cue, {sql_any("lower(text)", TIMES)} AS has_temporal_cue FROM e""")
def q01_scene_chunks(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), "text")
    return scenes.scene_chunks(docs, "\n", PLACES, TIMES)


@query(f"SELECT doc_id, {sql_cmi(sql_words('text'))} FROM documents")
def q02_cmi(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.code_mixing("text").alias("m")).select("doc_id", "m.*")


@query(f"""
WITH s AS (SELECT conv_id, turn, string_split(role || ': ' || coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS line_idx FROM s)
SELECT conv_id, turn, line_idx, contains(line, ':') AS is_dialogue,
  CASE WHEN contains(line, ':') THEN {sql_strip("regexp_extract(line, '^([^:]*):', 1)")} END AS speaker,
  CASE WHEN contains(line, ':') THEN {sql_strip("regexp_replace(line, '^[^:]*:', '')")} ELSE line END AS utterance
FROM l WHERE {sql_strip("line")} <> '' AND NOT (contains(line, ':') AND {sql_strip("regexp_replace(line, '^[^:]*:', '')")} = '')""")
def q03_dialogue_lines(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("dialogue"))
    return scenes.dialogue_lines(c, ["conv_id", "turn"]).select("conv_id", "turn", "line_idx", "is_dialogue", "speaker", "utterance")


@query(r"SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS tokens FROM conversations")
def q04_token_counts(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.token_count("text").alias("tokens"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s.,!?;:''\-]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def q05_noise_strip(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.noise_strip("text").alias("clean"))


def sql_casual(c: str) -> str:
    for a, b in ((r"\.m", "n"), ("ँ", "n"), ("aa", "a"), ("ii", "i"), ("uu", "u"), (r"\.a", "")):
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    for p in ("Th", "Dh", "Ph", "Kh", "Gh", "Ch", "Jh", "Bh", "Rh"):
        c = f"replace({c}, '{p}', '{p.lower()}')"
    return f"translate({c}, 'TDNRSL', 'tdnrsl')"


def sql_fixes(c: str) -> str:
    for a, b in lx.WORD_FIXES.items():
        c = rf"regexp_replace({c}, '(?i)\b{a}\b', '{b}', 'g')"
    return c


@query(rf"""
WITH c AS (SELECT doc_id, string_split({sql_casual("coalesce(text, '')")}, ' ') AS ws FROM documents)
SELECT doc_id, {sql_fixes(rf"list_aggregate(list_transform(ws, lambda w: CASE WHEN lower(regexp_replace(w, '[.,!?;:]*\z', '')) IN {sql_in(sorted(set(lx.SCHWA_EXCEPTIONS)))} THEN w ELSE regexp_replace(regexp_replace(w, '[.,!?;:]*\z', ''), '^([a-zA-Z]*[bcdfghjklmnpqrstvwxyz])a\z', '\1') || regexp_extract(w, '[.,!?;:]*\z') END), 'string_agg', ' ')")} AS roman
FROM c""")
def q06_casual_roman(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return t(spark, sf_dir, "documents").select("doc_id", tx.word_fixes(tx.schwa_deletion(tx.itrans_to_casual(text))).alias("roman"))


@query(rf"""
WITH p AS (SELECT DISTINCT lower({sql_squeeze(r"regexp_replace(x, '\(.*?\)', '', 'g')")}) AS phrase
           FROM (SELECT unnest(regexp_split_to_array(text, '[,/]')) AS x FROM benchmark))
SELECT DISTINCT unnest(regexp_extract_all(phrase, '[a-z]+')) AS word FROM p WHERE phrase <> ''""")
def q07_phrase_word_lexicon(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark").select(tx.slang_list("text").alias("slangs"))
    return slang.word_lexicon(slang.phrase_lexicon(b))


DF_LEXICON = f"""df_lexicon AS (
  SELECT word, count(*) AS df FROM (
    SELECT unnest(list_filter(list_distinct({sql_words("slang")}), lambda w: NOT list_contains({sql_words("neutral")}, w))) AS word FROM pairs)
  WHERE length(word) >= 2 AND word NOT IN {sql_in(lx.GRAMMAR_WORDS)} GROUP BY word HAVING count(*) >= 2)"""


@query(f"WITH {PAIRS}, {DF_LEXICON} SELECT word, df FROM df_lexicon")
def q08_df_lexicon(spark, sf_dir):
    return slang.frequent_new_words(pairs(spark, sf_dir), "neutral", "slang")


INSERTED = f"""side AS (
  SELECT conv_id, turn, 'n' AS side, unnest({sql_words("neutral")}) AS word FROM pairs
  UNION ALL SELECT conv_id, turn, 's', unnest({sql_words("slang")}) FROM pairs
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, word) AS k FROM side
), ins AS (
  SELECT conv_id, turn, word, k FROM ranked WHERE side = 's'
  EXCEPT SELECT conv_id, turn, word, k FROM ranked WHERE side = 'n')"""


@query(f"""WITH {PAIRS}, {INSERTED}
SELECT p.conv_id, p.turn, count(i.word) AS n_inserted, coalesce(string_agg(i.word, ' ' ORDER BY i.word), '') AS inserted
FROM pairs p LEFT JOIN ins i ON i.conv_id = p.conv_id AND i.turn = p.turn GROUP BY p.conv_id, p.turn""")
def q09_inserted_words(spark, sf_dir):
    p = pairs(spark, sf_dir).select("conv_id", "turn", metrics.inserted_words("neutral", "slang").alias("i"))
    return p.select("conv_id", "turn", F.size("i").cast("long").alias("n_inserted"), F.array_join("i", " ").alias("inserted"))


# ---- slang detection and metrics -------------------------------------------


def lexicon(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two-word phrases that begin the benchmark's texts, and their words."""
    w = tx.words("text")
    at = lambda i: F.concat(F.get(w, F.lit(i)), F.lit(" "), F.get(w, F.lit(i + 1)))
    phrases = t(spark, sf_dir, "benchmark").select(F.explode(F.array(at(0), at(4), at(9))).alias("phrase")).filter("phrase is not null").distinct()
    return phrases, slang.word_lexicon(phrases)


DETECTED = f"""phrases AS (
  SELECT DISTINCT phrase FROM (SELECT unnest([w[1] || ' ' || w[2], w[5] || ' ' || w[6], w[10] || ' ' || w[11]]) AS phrase
    FROM (SELECT {sql_words("text")} AS w FROM benchmark)) WHERE phrase IS NOT NULL
), singles AS (SELECT DISTINCT unnest(regexp_extract_all(phrase, '[a-z]+')) AS word FROM phrases
), hits AS (
  SELECT conv_id, turn, phrase FROM pairs, phrases WHERE contains(lower(slang), phrase) AND NOT contains(lower(neutral), phrase)
), inside AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(phrase, '[a-z]+')) AS word FROM hits
), valid AS (SELECT * FROM ins WHERE word IN (SELECT word FROM singles)
), det AS (
  SELECT conv_id, turn, 0 AS kind, phrase AS term FROM hits
  UNION ALL SELECT v.conv_id, v.turn, 1, v.word FROM valid v ANTI JOIN inside i ON i.conv_id = v.conv_id AND i.turn = v.turn AND i.word = v.word
), counts AS (
  SELECT p.*, (SELECT count(*) FROM ins i WHERE i.conv_id = p.conv_id AND i.turn = p.turn) AS n_inserted,
         (SELECT count(*) FROM valid v WHERE v.conv_id = p.conv_id AND v.turn = p.turn) AS n_valid,
         coalesce((SELECT list(term ORDER BY kind, term) FROM det d WHERE d.conv_id = p.conv_id AND d.turn = p.turn), []) AS detected
  FROM pairs p)"""


@query(f"WITH {PAIRS}, {INSERTED}, {DETECTED} SELECT conv_id, turn, n_inserted, n_valid, array_to_string(detected, '|') AS detected FROM counts")
def q10_slang_detect(spark, sf_dir):
    d = metrics.detect_slang(pairs(spark, sf_dir), *lexicon(spark, sf_dir))
    return d.select("conv_id", "turn", F.size("inserted").cast("long").alias("n_inserted"), F.size("valid").cast("long").alias("n_valid"), F.array_join("detected", "|").alias("detected"))


METRICS = f"""lines AS (
  SELECT *, list_filter(regexp_split_to_array(slang, '\\r\\n|\\n|\\r'), lambda x: {sql_strip("x")} <> '') AS ls FROM counts
), m AS (
  SELECT conv_id, turn, detected, len(ls) AS n_lines, len(detected) AS n_slang,
    len(list_filter(ls, lambda ln: len(list_filter(detected, lambda d: contains(lower(CASE WHEN contains(ln[1:20], ':') THEN regexp_replace(ln, '^[^:]*:', '') ELSE ln END), d))) > 0))::DOUBLE / greatest(len(ls), 1) AS coverage,
    len(detected)::DOUBLE / greatest(len(ls), 1) AS density,
    CASE WHEN n_inserted > 0 THEN n_valid::DOUBLE / n_inserted ELSE 1.0 END AS validity, {sql_cmi(sql_words("slang"))}
  FROM lines)"""
ALL_METRICS = f"{PAIRS}, {INSERTED}, {DETECTED}, {METRICS}"


def measured(spark, sf_dir) -> DataFrame:
    return metrics.scene_metrics(metrics.detect_slang(pairs(spark, sf_dir), *lexicon(spark, sf_dir)))


@query(f"""WITH {ALL_METRICS} SELECT conv_id, turn, n_lines, n_slang, round(coverage, 6) AS coverage, round(density, 6) AS density,
round(validity, 6) AS validity, cmi, en_ratio, hi_ratio FROM m""")
def q11_scene_metrics(spark, sf_dir):
    r = [F.round(c, 6).alias(c) for c in ("coverage", "density", "validity")]
    return measured(spark, sf_dir).select("conv_id", "turn", "n_lines", "n_slang", *r, "cmi", "en_ratio", "hi_ratio")


@query(f"""WITH {ALL_METRICS}, f AS (SELECT unnest(detected) AS term FROM m),
n AS (SELECT count(*) AS slang_total, count(DISTINCT lower(term)) AS slang_unique FROM f)
SELECT (SELECT count(*) FROM m) AS scenes, (SELECT round(avg(coverage), 4) FROM m) AS slang_coverage, (SELECT round(avg(density), 4) FROM m) AS slang_density,
 (SELECT round(avg(validity), 4) FROM m) AS slang_validity, (SELECT round(avg(cmi), 4) FROM m) AS cmi_mean, (SELECT round(avg(en_ratio), 4) FROM m) AS en_ratio_mean,
 (SELECT round(avg(hi_ratio), 4) FROM m) AS hi_ratio_mean, slang_total, slang_unique, CASE WHEN slang_total > 0 THEN round(slang_unique::DOUBLE / slang_total, 4) ELSE 0.0 END AS slang_diversity FROM n""")
def q12_script_rollup(spark, sf_dir):
    return metrics.script_rollup(measured(spark, sf_dir))


@query(f"WITH {ALL_METRICS} SELECT lower(term) AS term, count(*) AS n FROM (SELECT unnest(detected) AS term FROM m) GROUP BY 1 ORDER BY n DESC, term LIMIT 8")
def q13_top_slang(spark, sf_dir):
    return metrics.top_slang(measured(spark, sf_dir))


TOLD = f"""told AS (
  SELECT d.doc_id, count(*) AS total, count(*) FILTER (WHERE len(list_filter({sql_words("b.text")}, lambda w: w NOT IN {sql_in(lx.EVENT_STOP_WORDS)} AND contains(lower(coalesce(d.text, '')), w))) > 0) AS covered
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) OR b.item_id = (d.doc_id + 1) % (SELECT count(*) FROM benchmark)
  GROUP BY d.doc_id)"""


def told(spark, sf_dir) -> DataFrame:
    """Each document with two benchmark texts as its events."""
    b = t(spark, sf_dir, "benchmark")
    n = b.count()
    d = t(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array_distinct(F.array(F.col("doc_id") % n, (F.col("doc_id") + 1) % n))).alias("item_id"))
    d = d.join(b.select("item_id", F.col("text").alias("event")), "item_id")
    d = d.withColumn("c", metrics.covered_events("text", F.array("event")))
    return d.groupBy("doc_id").agg(F.sum("c.total").alias("total"), F.sum("c.covered").alias("covered"))


@query(f"WITH {TOLD} SELECT doc_id, total, covered, covered::DOUBLE / greatest(total, 1) AS recall FROM told")
def q14_event_recall(spark, sf_dir):
    return told(spark, sf_dir).withColumn("recall", F.col("covered") / F.greatest("total", F.lit(1)))


COSINE = """sims AS (
  SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
    (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def similar(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", sim.cosine(F.col("embedding"), F.col("other")).alias("similarity"))


@query(f"WITH {COSINE} SELECT vec_id, round(similarity, 6) AS similarity FROM sims")
def q15_cosine(spark, sf_dir):
    return similar(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {TOLD}, {COSINE}, j AS (SELECT doc_id, similarity, covered::DOUBLE / greatest(total, 1) AS recall FROM told JOIN sims ON vec_id = doc_id)
SELECT doc_id, round(similarity, 4) AS similarity, round(recall, 4) AS recall, similarity >= 0.1 AND recall >= 0.5 AS passed,
  CASE WHEN similarity >= 0.1 AND recall >= 0.5 THEN 'accept' ELSE 'rewrite' END AS action FROM j""")
def q16_validate(spark, sf_dir):
    rows = q14_event_recall(spark, sf_dir).join(similar(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return metrics.validate(rows.select("doc_id", "similarity", "recall"), min_similarity=0.1)


# ---- lexicons, cleaning, splits --------------------------------------------


def named_parts(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("control"), F.col("p_brand").alias("function"), F.split("p_name", " ").alias("slangs"))


LEXICON_COUNTS = """lex AS (
  SELECT 'control' AS key_kind, p_type AS key, lower(unnest(string_split(p_name, ' '))) AS slang FROM part
  UNION ALL SELECT 'function', p_brand, lower(unnest(string_split(p_name, ' '))) FROM part)"""


@query(f"WITH {LEXICON_COUNTS} SELECT key_kind, key, slang, count(*) AS cnt FROM lex GROUP BY ALL")
def q17_lexicon_by_key(spark, sf_dir):
    return slang.lexicon_counts(named_parts(spark, sf_dir))


@query(f"""WITH {LEXICON_COUNTS}, c AS (SELECT key AS control, slang, count(*) AS cnt FROM lex WHERE key_kind = 'control' GROUP BY ALL),
k AS (SELECT control, sum(cnt) AS total FROM c GROUP BY control ORDER BY total DESC, control LIMIT 5)
SELECT control, slang, cnt, row_number() OVER (PARTITION BY control ORDER BY cnt DESC, slang) AS rank FROM c JOIN k USING (control) QUALIFY rank <= 6""")
def q18_topk_per_control(spark, sf_dir):
    c = slang.lexicon_counts(named_parts(spark, sf_dir)).filter("key_kind = 'control'").select(F.col("key").alias("control"), "slang", "cnt")
    best = c.groupBy("control").agg(F.sum("cnt").alias("total")).orderBy(F.desc("total"), "control").limit(5)
    return relational.top_per_group(c.join(best.select("control"), "control", "left_semi"), ["control"], [F.desc("cnt"), F.col("slang")], 6)


RAW_PAIRS = [
    (0, " Woh mazak kar raha hai ", "Woh patti padha raha hai", "Patti padhana (trick), gap", "end", "Yes", "[assert happy]", "Idiom + x"),
    (1, "Tum kya kar rahe ho", "Bhai tum kya kar rahe ho", "Bhai / yaar,BHAI", "START,end/START", "no", "ASSERT_NEUTRAL", ""),
    (2, "Tum kya kar rahe ho", "Bhai tum kya kar rahe ho", "bhai", None, None, "[ASSERT_NEUTRAL]", None),
    (3, "Same line", "same LINE", "same", "MIDDLE", "YES ", "x", "Filler"),
    (4, "Aaj mausam accha hai", "Aaj mausam mast hai", "scene", "nowhere", "yes", "ASSERT POSITIVE", "slang eval"),
    (5, None, "kuch bhi yaar", "yaar", "END", "no", "", "filler"),
    (6, "Kaam ho gaya", "Kaam ho gaya boss (sach)", "boss", "end", "no", "info_statement", "Filler+tag"),
]
RAW_SCHEMA = "row_id long, neutral string, output string, possible_slangs string, slang_location string, multiple string, control_tokens string, function string"


def sql_value(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


RAW_VALUES = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in RAW_PAIRS)
STEMS = r"""len(list_filter(slangs, lambda s: contains(lower(output), lower(s)) OR len(list_filter(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'),
  lambda w: len(list_filter(regexp_extract_all(lower(output), '[\p{L}\p{N}_]+'), lambda o: starts_with(o, CASE WHEN length(w) >= 5 THEN w[1:4] ELSE w END))) > 0)) > 0)) > 0"""


@query(rf"""
WITH raw(row_id, neutral, output, possible_slangs, slang_location, multiple, control_tokens, function) AS (VALUES {RAW_VALUES}), a AS (
  SELECT row_id, {sql_strip("coalesce(neutral, '')")} AS neutral, {sql_strip("coalesce(output, '')")} AS output,
    replace(upper(regexp_replace({sql_strip("coalesce(control_tokens, '')")}, '^[\[\]]+|[\[\]]+$', '', 'g')), ' ', '_') AS control,
    coalesce(nullif(regexp_replace(lower({sql_strip("split_part(coalesce(function, ''), '+', 1)")}), '\s+', '_', 'g'), ''), 'filler') AS function,
    lower({sql_strip("coalesce(multiple, '')")}) = 'yes' AS multi_allowed,
    list_filter(list_transform(regexp_split_to_array(coalesce(slang_location, ''), '[,/]'), lambda p: upper({sql_strip("p")})), lambda p: p IN ('START', 'MIDDLE', 'END')) AS ps,
    list_filter(list_transform(regexp_split_to_array(coalesce(possible_slangs, ''), '[,/]'), lambda p: {sql_squeeze(r"regexp_replace(p, '\(.*?\)', '', 'g')")}), lambda p: p <> '') AS ss
  FROM raw
), b AS (
  SELECT *, list_filter(ps, lambda p, i: list_position(ps, p) = i) AS positions,
    list_filter(ss, lambda s, i: list_position(list_transform(ss, lambda y: lower(y)), lower(s)) = i) AS slangs FROM a
), c AS (SELECT * FROM b WHERE {STEMS} AND lower(neutral) <> lower(output) AND neutral <> '' AND output <> '')
SELECT row_id, neutral, output, control, function, CASE WHEN len(positions) = 0 THEN 'END' ELSE array_to_string(positions, '|') END AS positions, multi_allowed, array_to_string(slangs, '|') AS slangs
FROM c QUALIFY row_number() OVER (PARTITION BY neutral, output, control ORDER BY row_id) = 1""")
def q19_clean_pairs(spark, sf_dir):
    raw = spark.createDataFrame(RAW_PAIRS, RAW_SCHEMA).withColumn("context", F.lit(None).cast("string")).withColumn("social_context", F.lit(""))
    kept, _ = dp.clean_pairs(raw, fuzzy=False)
    return kept.select("row_id", "neutral", "output", "control", "function", F.array_join("positions", "|").alias("positions"), "multi_allowed", F.array_join("slangs", "|").alias("slangs"))


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g')) AS key FROM documents)
SELECT doc_id, md5(key) AS key FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""")
def q20_dedup_keep_first(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.dedup_key(F.coalesce("text", F.lit("")))).alias("key"))
    return relational.keep_first(d, ["key"], ["doc_id"])


EXAMPLES = f"""ex AS (
  SELECT DISTINCT 'insert slang | control: ASSERT_NEUTRAL | ' || neutral AS input, slang AS target FROM pairs WHERE lower(neutral) <> lower(slang))"""


@query(f"""WITH {PAIRS}, {EXAMPLES}
SELECT md5(input) AS input, md5(target) AS target, row_number() OVER (ORDER BY md5(input || '|' || target), input, target) <= floor(0.08::DOUBLE * count(*) OVER ()) AS is_validation FROM ex""")
def q21_train_val_split(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("control", F.lit("ASSERT_NEUTRAL")).withColumnRenamed("slang", "output")
    ex = dp.editor_split(dp.editor_examples(p, ["conv_id", "turn"]))
    return ex.select(F.md5("input").alias("input"), F.md5("target").alias("target"), "is_validation")


@query("""WITH u AS (SELECT p_type, p_partkey, p_size, ('0x' || substr(md5('7|' || p_partkey), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM part)
SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY -ln(greatest(u, 1e-15)) / p_size, p_partkey) AS rank FROM u QUALIFY rank <= 5""")
def q22_weighted_candidates(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    s = relational.weighted_sample(p, ["p_type"], F.col("p_size").cast("double"), relational.unit_hash(F.lit("7"), "p_partkey"), 5, "p_partkey")
    return s.select("p_type", "p_partkey", "rank")


POOL_PAIRS = [
    ("ASSERT_HAPPY", "idiom", ["mast", "jhakaas"]), ("ASSERT_POSITIVE", "slang_eval", ["kadak"]), ("ASSERT_STRESS", "filler", ["uff", "yaar"]),
    ("ASSERT_ANGER", "negative_eval", ["bakwaas"]), ("REQUEST_URGENCY", "tag", ["fatafat", "jhat", "abhi ke abhi", "chal", "jaldi", "turant se"]),
]
POOL_WANTED = [("ASSERT_POSITIVE", "happy"), ("REQUEST_URGENCY", "neutral"), ("CASUAL_ASSERTION", "sad"), ("CASUAL_ASSERTION", None), ("EXPRESS_STRESS", "Angry")]
POOL_LEX = ", ".join(f"('{c}', '{f}', '{s}')" for c, f, ss in POOL_PAIRS for s in ss)
POOL_MAP = ", ".join([f"('i', '{k}', '{c}')" for k, cs in lx.INTENT_CONTROLS.items() for c in cs] + [f"('e', '{k}', '{c}')" for k, cs in lx.EMOTION_CONTROLS.items() for c in cs])


@query(f"""
WITH lex(control, func, slang) AS (VALUES {POOL_LEX}), mp(kind, k, control) AS (VALUES {POOL_MAP}), w(intent, emotion) AS (VALUES {", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in POOL_WANTED)}),
b AS (SELECT intent, emotion, coalesce((SELECT list(DISTINCT slang) FROM lex JOIN mp USING (control) WHERE (kind = 'i' AND k = intent) OR (kind = 'e' AND k = lower(coalesce(emotion, 'neutral')))), []) AS p FROM w),
c AS (SELECT intent, emotion, CASE WHEN len(p) < 6 THEN list_distinct(list_concat(p, (SELECT list(slang) FROM lex WHERE func IN {sql_in(lx.COLOURFUL_FUNCTIONS)}))) ELSE p END AS p FROM b),
d AS (SELECT intent, emotion, CASE WHEN len(p) < 4 THEN list_distinct(list_concat(p, (SELECT list(slang) FROM lex WHERE func = 'filler'))) ELSE p END AS p FROM c)
SELECT intent, emotion, array_to_string(list_sort(p), '|') AS pool FROM d""")
def q23_slang_pool(spark, sf_dir):
    p = spark.createDataFrame(POOL_PAIRS, "control string, function string, slangs array<string>")
    wanted = spark.createDataFrame(POOL_WANTED, "intent string, emotion string")
    out = slang.pools(wanted, slang.lexicon_sets(p, "control"), slang.lexicon_sets(p, "function"), slang.filler_pool(p))
    return out.withColumn("pool", F.array_join("pool", "|"))


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN {sql_any("lower(text)", lx.ROLE_KEYWORDS["elder"])} THEN 'elder' WHEN {sql_any("lower(text)", lx.ROLE_KEYWORDS["authority"])} THEN 'authority' ELSE 'peer' END AS social_role FROM documents)
SELECT doc_id, social_role, CASE WHEN social_role = 'peer' THEN 5 ELSE 0 END AS slang_level FROM r""")
def q24_role_inference(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", ch.social_role("text").alias("social_role"))
    return d.withColumn("slang_level", ch.slang_level("social_role"))


# ---- characters and gates --------------------------------------------------


@query("SELECT conv_id, role AS name, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) = 1")
def q25_first_profile(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("name"), "turn")
    return ch.first_profiles(c, "conv_id", ("turn",))


@query("""WITH m AS (SELECT user_id, event_type, max_by(props, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS merged FROM m GROUP BY user_id""")
def q26_pronoun_merge(spark, sf_dir):
    m = ch.merged_map(t(spark, sf_dir, "events"), ["user_id"], "event_type", "props", "event_id")
    return m.select("user_id", F.array_join(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


MOODS = {"error": "angry", "purchase": "happy", "click": "anxious", "signup": "sad"}


@query(f"""
WITH RECURSIVE s AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
    CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MOODS.items())} END AS trg FROM events
), f(user_id, k, emotion, tenths) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 'neutral', 0 FROM events
  UNION ALL
  SELECT s.user_id, s.k, coalesce(s.trg, f.emotion),
    CASE WHEN coalesce(s.trg, f.emotion) IN ('angry', 'anxious', 'urgent') THEN least(10, f.tenths + 2) WHEN coalesce(s.trg, f.emotion) = 'happy' THEN greatest(0, f.tenths - 3) ELSE f.tenths END
  FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT user_id, emotion, k AS turn_count, tenths / 10.0::DOUBLE AS stress_index FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def q27_emotion_stress(spark, sf_dir):
    trigger = F.lit(None).cast("string")
    for kind, emotion in MOODS.items():
        trigger = F.when(F.col("event_type") == kind, emotion).otherwise(trigger)
    e = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", trigger.alias("trigger"))
    return ch.final_states(e, ["user_id"], ["ts", "event_id"], "trigger")


def gated(spark, sf_dir) -> DataFrame:
    """Conversations as scenes: the system is an authority, a third of the lines inform."""
    c = t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_idx"), F.col("role").alias("speaker"), tx.token_count("text").alias("tokens"))
    c = c.withColumn("social_role", F.when(F.col("speaker") == "system", "authority").otherwise("peer")).withColumn("slang_level", F.lit(5))
    c = c.withColumn("intent", F.when(F.col("tokens") % 3 == 0, "INFORM_NEUTRAL").otherwise("CASUAL_ASSERTION")).withColumn("added", F.greatest(F.lit(1), F.floor(F.col("tokens") / 3)))
    return gates.gate_lines(c, ["conv_id"])


GATES = """lines AS (
  SELECT conv_id, turn, role, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS tokens FROM conversations
), l AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role <> 'system' AS one, tokens % 3 <> 0 AS two FROM lines
), g(conv_id, k, total, slang, stopped) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM l
  UNION ALL
  SELECT l.conv_id, l.k, CASE WHEN one AND two THEN g.total + tokens ELSE g.total END,
    CASE WHEN one AND two AND (g.total + tokens = 0 OR g.slang::DOUBLE / (g.total + tokens) < 0.25) THEN g.slang + greatest(1, tokens // 3) ELSE g.slang END,
    CASE WHEN NOT one THEN 1 WHEN NOT two THEN 2 WHEN NOT (g.total + tokens = 0 OR g.slang::DOUBLE / (g.total + tokens) < 0.25) THEN 3 ELSE 0 END
  FROM g JOIN l ON l.conv_id = g.conv_id AND l.k = g.k + 1)"""


@query(f"""WITH RECURSIVE {GATES}
SELECT l.conv_id, l.turn AS line_idx, g.stopped = 0 AS go, nullif(g.stopped, 0) AS gate_stopped, g.total, g.slang, CASE WHEN one THEN CASE WHEN two THEN 'CASUAL_ASSERTION' ELSE 'INFORM_NEUTRAL' END END AS intent
FROM g JOIN l ON l.conv_id = g.conv_id AND l.k = g.k""")
def q28_gate_decisions(spark, sf_dir):
    return gated(spark, sf_dir).select("conv_id", "line_idx", "go", "gate_stopped", "total", "slang", "intent")


@query(f"""WITH RECURSIVE {GATES}, z AS (SELECT conv_id, total, slang FROM g WHERE stopped IN (0, 3) AND k > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1)
SELECT conv_id, total AS total_tokens, slang AS slang_tokens, round(CASE WHEN total > 0 THEN slang::DOUBLE / total ELSE 0.0 END, 3) AS density, CASE WHEN total > 0 THEN slang::DOUBLE / total ELSE 0.0 END < 0.25 AS under_budget FROM z""")
def q29_density_report(spark, sf_dir):
    return gates.density_report(gated(spark, sf_dir), ["conv_id"])


@query("""SELECT doc_id, source, coalesce(lag(left(text, 30)) OVER w, CASE WHEN row_number() OVER w = 1 THEN 'This is the first scene.' END) AS previous_goal
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def q30_prev_goal(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 30).alias("scene_goal"))
    return scenes.previous_goal(d, keys=["source"], order="doc_id").select("doc_id", "source", "previous_goal")


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'again' ELSE 'before' END AS result FROM documents""")
def q31_retry_carry(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id")
    failed = t(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return relational.carry_over(d.withColumn("result", F.lit("before")), d.withColumn("result", F.lit("again")), failed, ["doc_id"])


# ---- augmentation and the rest ---------------------------------------------


def checked(spark, sf_dir) -> DataFrame:
    p = pairs(spark, sf_dir).select("conv_id", "turn", "neutral", F.col("slang").alias("output"), F.regexp_extract("neutral", "[a-z]+", 0).alias("slang"))
    seen = t(spark, sf_dir, "benchmark").select(F.col("text").alias("output"), F.col("text").alias("neutral"))
    return dp.structural_check(p, seen, ["conv_id", "turn"], min_ratio=None)


REASONS = f"""c AS (
  SELECT conv_id, turn, neutral, slang AS output, regexp_extract(neutral, '[a-z]+') AS slang, trim(regexp_replace(lower(slang), '[^a-z0-9 ]', '', 'g')) AS ko FROM pairs
), r AS (
  SELECT *, CASE WHEN neutral = '' OR output = '' OR slang = '' THEN 'empty' WHEN regexp_matches(neutral, '[ऀ-ॿ]') OR regexp_matches(output, '[ऀ-ॿ]') THEN 'devanagari'
    WHEN NOT contains(lower(output), lower(slang)) THEN 'slang_absent' WHEN lower(neutral) = lower(output) THEN 'no_change'
    WHEN len(regexp_extract_all(neutral, '\\S+')) NOT BETWEEN 4 AND 26 THEN 'length'
    WHEN ko IN (SELECT trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) FROM benchmark) THEN 'duplicate' ELSE 'ok' END AS reason FROM c
), q AS (
  SELECT conv_id, turn, CASE WHEN reason = 'ok' AND row_number() OVER (PARTITION BY ko, reason = 'ok' ORDER BY conv_id, turn) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r)"""


@query(f"WITH {PAIRS}, {REASONS} SELECT conv_id, turn, reason FROM q")
def q32_structural_reasons(spark, sf_dir):
    return checked(spark, sf_dir).select("conv_id", "turn", "reason")


@query(f"WITH {PAIRS}, {REASONS} SELECT reason, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM q GROUP BY reason")
def q33_reason_counts(spark, sf_dir):
    return dp.reason_counts(checked(spark, sf_dir))


@query("""WITH c AS (SELECT greatest(3, floor(count(*) / 80)) AS cap FROM part),
m AS (SELECT *, max(CASE WHEN p_size < cap THEN 1 ELSE 0 END) OVER (PARTITION BY p_name) AS room FROM part, c)
SELECT p_partkey, p_name FROM m WHERE room = 0 OR p_size < cap""")
def q34_slang_cap(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return relational.capped_pool(p, ["p_name"], F.col("p_size"), relational.usage_cap(p.count() // 2)).select("p_partkey", "p_name")


RAW_LABELS = ["[assert surprise]", " EXPRESS_STRESS ", "info statement", "nonsense", "", "request_urgency", "[ASSERT_FEAR]"]


@query(f"""WITH m(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lx.CANONICAL_CONTROLS.items())}), r(raw) AS (VALUES {", ".join(f"('{x}')" for x in RAW_LABELS)}),
n AS (SELECT raw, replace(upper(regexp_replace({sql_strip("raw")}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')), ' ', '_') AS control FROM r)
SELECT raw, control, coalesce(v, 'ASSERT_NEUTRAL') AS canonical FROM n LEFT JOIN m ON k = control""")
def q35_label_canon(spark, sf_dir):
    r = spark.createDataFrame([(x,) for x in RAW_LABELS], "raw string")
    return r.select("raw", tx.control_token("raw").alias("control"), tx.canonical_control("raw").alias("canonical"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, (props::JSON ->> '$.k')::INTEGER AS again FROM events")
def q36_json_events(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    fenced = F.concat(F.lit("```json\n["), F.regexp_replace("props", r"\}$", ",}"), F.lit(",]\n```"))
    return e.select("event_id", tx.json_object("props", "k int")["k"].alias("k"), F.try_element_at(tx.json_objects(fenced, "k int"), F.lit(1))["k"].alias("again"))


@query(f"""WITH {PAIRS}, {DF_LEXICON}, r AS (SELECT *, CASE WHEN turn % 4 = 0 THEN slang ELSE neutral END AS ref FROM pairs),
w AS (SELECT conv_id, turn, unnest(list_filter({sql_words("slang")}, lambda w: NOT list_contains({sql_words("neutral")}, w))) AS word FROM pairs),
h AS (SELECT count(*) AS hits FROM (SELECT DISTINCT conv_id, turn FROM w JOIN df_lexicon USING (word)))
SELECT count(*) AS n_rows, round((SELECT hits FROM h)::DOUBLE / count(*), 3) AS slang_hit,
  round(avg((slang = neutral)::INT), 3) AS copies_input, round(avg(contains(slang, '<extra_id_')::INT), 3) AS has_sentinel, round(avg((slang = ref)::INT), 3) AS matches_ref, round(avg((slang <> neutral)::INT), 3) AS edits_made FROM r""")
def q37_editor_eval(spark, sf_dir):
    p = pairs(spark, sf_dir)
    rows = p.select(F.col("slang").alias("prediction"), "neutral", F.when(F.col("turn") % 4 == 0, F.col("slang")).otherwise(F.col("neutral")).alias("reference"))
    return metrics.editor_metrics(rows, slang.frequent_new_words(p, "neutral", "slang"))


@query(f"""WITH {PAIRS} SELECT conv_id, turn, round(CASE WHEN len({sql_words("slang")}) > 0 THEN list_sum(list_transform({sql_words("slang")}, lambda w: CASE WHEN list_contains({sql_words("neutral")}, w) THEN 1.0::DOUBLE ELSE 2.0 END)) / len({sql_words("slang")}) ELSE 0.0 END, 6) AS weight FROM pairs""")
def q38_edit_weight(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.edit_weight("neutral", "slang"), 6).alias("weight"))


@query("SELECT conv_id, md5(string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS script FROM conversations GROUP BY conv_id")
def q39_screenplay(spark, sf_dir):
    return scenes.screenplay(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text").withColumn("script", F.md5("script"))


@query("""SELECT coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AS passes, count(*) AS n, round(avg(quality), 2) AS quality_mean FROM labels GROUP BY 1""")
def q40_judge_gate(spark, sf_dir):
    rows = t(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1).withColumn("calm", F.col("toxic") == 0)
    return rows.groupBy(metrics.judge_passes("good", "calm").alias("passes")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 2).alias("quality_mean"))


WRAPPED = r"regexp_extract(text, '\S+') || ', ' || text || ' ' || regexp_extract(text, '\S+') || '!'"


@query(rf"""WITH w AS (SELECT conv_id, turn, {WRAPPED} AS line FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS p FROM w)
SELECT conv_id, turn, md5(CASE WHEN len(p) >= 3 AND p[1][-1] = ',' AND regexp_replace(lower(p[1]), ',+$', '') = lower(regexp_replace(p[-1], '[.,!?]+$', '')) THEN array_to_string(p[:-2], ' ') ELSE line END) AS line FROM s""")
def q41_wrap_dedupe(spark, sf_dir):
    first = F.regexp_extract("text", r"\S+", 0)
    c = t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.concat(first, F.lit(", "), "text", F.lit(" "), first, F.lit("!")).alias("line"))
    return c.select("conv_id", "turn", F.md5(tx.unwrap("line")).alias("line"))


@query(rf"""WITH {PAIRS}, s AS (SELECT conv_id, turn, {sql_words("neutral")}[1:3] AS slangs, slang AS output FROM pairs)
SELECT conv_id, turn, {STEMS} AS present FROM s""")
def q42_stem_match(spark, sf_dir):
    p = pairs(spark, sf_dir).select("conv_id", "turn", F.slice(tx.words("neutral"), 1, 3).alias("slangs"), F.col("slang").alias("output"))
    return p.select("conv_id", "turn", dp.stems_present("slangs", "output").alias("present"))


@query()
def q43_fuzzy(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    rows = b.join(other, "item_id")
    return rows.select("item_id", F.round(sim.partial_ratio("other", "text"), 4).alias("partial"), F.round(sim.token_sort_ratio(F.lower("text"), F.lower("other")), 4).alias("token_sort"))


HINDI = ["तुम क्या कर रहे हो? मैं ठीक हूँ।", "राम घर गया। वह खुश था।", "नमस्ते! ##00:01:30##", "सुबह वह स्कूल गया।\n\nशाम को राम बाज़ार से आया।"]


@query()
def q44_transliterate(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(HINDI)), "id int, text string").select("id", transliterate("text").alias("roman"))


@query()
def q45_story_run(spark, sf_dir):
    stories = spark.createDataFrame([(i, s) for i, s in enumerate(HINDI)], "story_id int, text string")
    p = spark.createDataFrame(POOL_PAIRS, "control string, function string, slangs array<string>")
    done = story.run(stories, p)["scenes"]
    return done.select("story_id", "scene_idx", "neutral", "slang", "passed", "recall")


REPLIES = ['"ARAV: Chalo bhai"', "Chalo ghar: abhi", "'Theek hai'\nAur kuch", "Note To Self: run", "", 'insert slang | control: A | Tum | kaho', "ok"]


@query(rf"""WITH r(raw) AS (VALUES {", ".join("(" + sql_value(x) + ")" for x in REPLIES)}), f AS (SELECT raw, regexp_replace({sql_strip(f"split_part({sql_strip('raw')}, chr(10), 1)")}, '^["'']+|["'']+$', '', 'g') AS line FROM r),
h AS (SELECT *, regexp_extract(line, '^([^:]*):', 1) AS head FROM f)
SELECT raw, CASE WHEN head <> '' AND len(regexp_extract_all(head, '\S+')) <= 2 AND (head = upper(head) OR head = array_to_string(list_transform(string_split(head, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) THEN {sql_strip("regexp_replace(line, '^[^:]*:', '')")} ELSE line END AS line,
  {sql_strip("CASE WHEN len(string_split(raw, ' | ')) >= 3 THEN array_to_string(string_split(raw, ' | ')[3:], ' | ') ELSE string_split(raw, ' | ')[-1] END")} AS neutral,
  CASE WHEN regexp_extract(upper(raw), '[A-Z_]+') IN {sql_in(lx.INTENTS)} THEN regexp_extract(upper(raw), '[A-Z_]+') ELSE 'CASUAL_ASSERTION' END AS intent FROM h""")
def q46_reply_cleanup(spark, sf_dir):
    r = spark.createDataFrame([(x,) for x in REPLIES], "raw string")
    return r.select("raw", tx.model_line("raw").alias("line"), tx.neutral_of("raw").alias("neutral"), tx.intent_label("raw").alias("intent"))


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip("x")}), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, len(ss) AS n_sentences, md5(array_to_string(ss, ' ')) AS joined FROM s""")
def q47_sentences(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", tx.split_indic(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.md5(tx.rejoin("s")).alias("joined"))


@query(f"""WITH i AS (SELECT conv_id, turn, lower({sql_strip("coalesce(text, '')")}) AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k = '' THEN 'INFORM_NEUTRAL' WHEN k LIKE '%?' THEN 'QUESTION_FORMAL' WHEN {sql_any("k", lx.EMOTION_TRIGGERS["urgent"])} THEN 'REQUEST_URGENCY' WHEN {sql_any("k", lx.EMOTION_TRIGGERS["angry"])} THEN 'ASSERT_FRUSTRATION'
 WHEN {sql_any("k", lx.EMOTION_TRIGGERS["happy"])} THEN 'ASSERT_POSITIVE' WHEN {sql_any("k", lx.EMOTION_TRIGGERS["anxious"])} THEN 'EXPRESS_STRESS' ELSE 'CASUAL_ASSERTION' END AS intent FROM i""")
def q48_intents(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("utterance"))
    return pv.classify_intents(c, pv.rule(pv.keyword_intent())).select("conv_id", "turn", "intent")


@query(f"""WITH {COSINE}, {TOLD}, j AS (SELECT round(similarity, 4) AS similarity, round(covered::DOUBLE / greatest(total, 1), 4) AS recall FROM told JOIN sims ON vec_id = doc_id)
SELECT count(*) AS n_scenes, round(avg(similarity), 4) AS semantic_sim_mean, round(min(similarity), 4) AS semantic_sim_min, round(avg(recall), 4) AS event_recall_mean,
 (SELECT round(avg(quality), 2) FROM labels) AS emotion_fit_mean, (SELECT round(avg(toxic), 2) FROM labels) AS placement_mean FROM j""")
def q49_report(spark, sf_dir):
    judged = t(spark, sf_dir, "labels").select(F.col("quality").alias("emotion_fit"), F.col("toxic").alias("placement"))
    return metrics.report(q16_validate(spark, sf_dir), judged)


@query("""WITH n AS (SELECT doc_id, max(toxic) AS toxic, count(*) AS c FROM labels GROUP BY doc_id)
SELECT d.doc_id, coalesce(toxic, -1) AS toxic, e.vec_id FROM documents d LEFT JOIN n USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id""")
def q50_scene_joins(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id")
    looked = relational.left_lookup(d, t(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic")
    zipped = relational.zip_join(looked, t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), ["doc_id"])
    return zipped.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), "vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q51_resume(spark, sf_dir):
    from ..sources.files import resume

    return resume(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")


@query("""WITH s AS (SELECT p_type AS key, unnest(string_split(p_name, ' ')) AS slang FROM part), f AS (SELECT slang, count(*) AS freq, string_agg(DISTINCT key, '|' ORDER BY key) AS controls FROM s GROUP BY slang)
SELECT 'set' AS kind, key, string_agg(DISTINCT slang, '|' ORDER BY slang) AS items, NULL::BIGINT AS freq FROM s GROUP BY key UNION ALL SELECT 'slang', slang, controls, freq FROM f""")
def q52_lexicon_sets(spark, sf_dir):
    p = named_parts(spark, sf_dir)
    sets = slang.lexicon_sets(p, "control").select(F.lit("set").alias("kind"), "key", F.array_join("slangs", "|").alias("items"), F.lit(None).cast("long").alias("freq"))
    freq = slang.slang_frequency(p.select("control", F.explode("slangs").alias("slang")))
    return sets.unionByName(freq.select(F.lit("slang").alias("kind"), F.col("slang").alias("key"), F.array_join("controls", "|").alias("items"), "freq"))


CAST = [(1, 0, ["Ram", "Diary", "ram"], ["Sita", "RAM"]), (1, 1, ["Sita", "Log"], None), (2, 0, None, ["Mohan"]), (2, 1, [], [])]


@query("SELECT * FROM (VALUES (1, 'Ram', 0), (1, 'Sita', 0), (2, 'Mohan', 0)) AS v(story_id, name, scene_idx)")
def q53_cast(spark, sf_dir):
    s = spark.createDataFrame(CAST, "story_id int, scene_idx int, characters array<string>, found array<string>")
    return ch.first_profiles(ch.names_of(s, found="found")).select("story_id", "name", "scene_idx")


@query("""WITH u AS (SELECT p_partkey, ('0x' || substr(md5('mode|' || p_partkey), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM part)
SELECT CASE WHEN u < 0.85 THEN 'variant' ELSE 'novel' END AS mode, count(*) AS n FROM u GROUP BY 1""")
def q54_mode_mix(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(relational.mode_mix(relational.unit_hash(F.lit("mode"), "p_partkey")).alias("mode"))
    return p.groupBy("mode").agg(F.count("*").alias("n"))


@query()
def q55_usage_weighted(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("line"), F.array(*[F.lit(x) for x in ("yaar", "mast", "kadak", "bhai", "scene")]).alias("pool"))
    return slang.usage_fold(c, "story", ["line"]).select("story", "line", "taken")


# ---- making pairs, the editor, the baseline ---------------------------------


def sql_unit(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


def sql_draw(attempts: str, key: list[str], seed: str) -> str:
    """CTEs: items, pools (control or '', slang, weight) and ``drawn``, each attempt with its slang."""
    ks = ", ".join(key)
    return f"""named AS (SELECT p_type AS control, unnest(string_split(p_name, ' ')) AS slang, p_size FROM part),
taken AS (SELECT slang, count(*) AS used FROM named WHERE p_size = 1 GROUP BY slang),
freqs AS (SELECT slang, count(*) AS freq FROM named GROUP BY slang),
items AS (SELECT control, slang, 1.0::DOUBLE / (1 + 3.0::DOUBLE * coalesce(used, 0) + 0.1::DOUBLE * freq) AS w, coalesce(used, 0) < 4 AS free
  FROM (SELECT DISTINCT control, slang FROM named) JOIN freqs USING (slang) LEFT JOIN taken USING (slang)),
both_ AS (SELECT * FROM items UNION ALL SELECT '', slang, sum(w), bool_or(free) FROM items GROUP BY slang),
pools AS (SELECT * FROM both_ QUALIFY free OR NOT bool_or(free) OVER (PARTITION BY control)),
drawn AS (SELECT {ks}, a.control, arg_min(slang, {{'k': -ln(greatest({sql_unit(f"'{seed}'", *key, "slang")}, 1e-15)) / w, 's': slang}}) AS slang
  FROM (SELECT *, CASE WHEN control IN (SELECT control FROM items) THEN control ELSE '' END AS c FROM {attempts}) a JOIN pools ON pools.control = a.c GROUP BY {ks}, a.control)"""


def draw_inputs(spark, sf_dir):
    """Pools of the parts' names, where names of the smallest parts are used already."""
    p = named_parts(spark, sf_dir)
    used = t(spark, sf_dir, "part").filter("p_size = 1").select(F.explode(F.split("p_name", " ")).alias("slang")).groupBy("slang").agg(F.count("*").alias("used"))
    return augment.draw_pools(augment.lexicon_items(p), used, 4)


@query(f"""WITH att AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'none' ELSE p_type END AS control FROM lineitem JOIN part ON p_partkey = l_partkey),
{sql_draw("att", ["l_orderkey", "l_linenumber"], "11")} SELECT slang, count(*) AS draws, sum(l_orderkey) AS orders FROM att JOIN drawn USING (l_orderkey, l_linenumber, control) GROUP BY slang""")
def q56_draw_slang(spark, sf_dir):
    control = F.when(F.col("l_linenumber") == 7, "none").otherwise(F.col("p_type")).alias("control")
    att = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", control)
    drawn = augment.draw_slang(att, draw_inputs(spark, sf_dir), ["l_orderkey", "l_linenumber"], "11")
    return drawn.groupBy("slang").agg(F.count("*").alias("draws"), F.sum("l_orderkey").alias("orders"))


@query(rf"""WITH {PAIRS}, att AS (
  SELECT p.conv_id, p.turn, {sql_strip("neutral")} AS neutral, slang AS other, coalesce(p_type, 'none') AS control, CASE WHEN {sql_unit("'mode'", "p.conv_id", "p.turn")} < 0.85 THEN 'variant' ELSE 'novel' END AS mode
  FROM pairs p LEFT JOIN part ON p_partkey = conv_id
), {sql_draw("att", ["conv_id", "turn"], "13")}, made AS (
  SELECT a.conv_id, a.turn, d.slang, mode, CASE WHEN (a.conv_id + a.turn) % 7 = 3 THEN 'api_error' WHEN (a.conv_id + a.turn) % 7 = 5 THEN 'unparseable' END AS broken,
    CASE WHEN mode = 'variant' THEN neutral ELSE {sql_strip("other")} END AS neutral, {sql_strip("d.slang || ', ' || CASE WHEN mode = 'variant' THEN neutral ELSE other END")} AS output
  FROM att a JOIN drawn d USING (conv_id, turn)
), k AS (
  SELECT *, trim(regexp_replace(lower(output), '[^a-z0-9 ]', '', 'g')) AS ko, CASE WHEN mode = 'novel' THEN trim(regexp_replace(lower(neutral), '[^a-z0-9 ]', '', 'g')) END AS kn FROM made WHERE broken IS NULL
), old AS (
  SELECT trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g')) AS k FROM benchmark
), r AS (
  SELECT *, CASE WHEN neutral = '' OR output = '' THEN 'empty' WHEN regexp_matches(neutral, '[ऀ-ॿ]') OR regexp_matches(output, '[ऀ-ॿ]') THEN 'devanagari'
    WHEN NOT contains(lower(output), lower(slang)) THEN 'slang_absent' WHEN lower(neutral) = lower(output) THEN 'no_change'
    WHEN len(regexp_extract_all(neutral, '\S+')) NOT BETWEEN 4 AND 26 THEN 'length'
    WHEN ko IN (FROM old) OR coalesce(kn IN (FROM old), false) THEN 'duplicate' ELSE 'ok' END AS reason FROM k
), r2 AS (
  SELECT * REPLACE (CASE WHEN reason = 'ok' AND row_number() OVER (PARTITION BY ko, reason ORDER BY conv_id, turn) > 1 THEN 'duplicate' ELSE reason END AS reason) FROM r
), r3 AS (
  SELECT * REPLACE (CASE WHEN reason = 'ok' AND kn IS NOT NULL AND row_number() OVER (PARTITION BY kn, reason ORDER BY conv_id, turn) > 1 THEN 'duplicate' ELSE reason END AS reason) FROM r2
)
SELECT conv_id, turn, mode, slang, CASE WHEN reason = 'ok' AND length(output) % 4 = 0 THEN 'judge_reject' ELSE reason END AS reason FROM r3
UNION ALL SELECT conv_id, turn, mode, slang, broken FROM made WHERE broken IS NOT NULL""")
def q57_attempt_outcomes(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("conv_id"), F.col("p_type").alias("control"))
    mode = relational.mode_mix(relational.unit_hash(F.lit("mode"), "conv_id", "turn"))
    att = pairs(spark, sf_dir).join(part, "conv_id", "left").select("conv_id", "turn", "neutral", F.col("slang").alias("other"), F.coalesce("control", F.lit("none")).alias("control"), mode.alias("mode"))
    drawn = augment.draw_slang(att, draw_inputs(spark, sf_dir), ["conv_id", "turn"], "13")
    line = F.when(F.col("mode") == "variant", tx.strip("neutral")).otherwise(F.col("other"))
    answer = F.to_json(F.struct(line.alias("neutral"), F.concat("slang", F.lit(", "), line).alias("output")))
    turn = (F.col("conv_id") + F.col("turn")) % 7
    asked = pv.rule(F.when(turn == 3, None).when(turn == 5, "no record").otherwise(answer))(drawn)
    grants = F.to_json(F.struct(*[(F.length("output") % 4 != 0).alias(v) for v in augment.VERDICTS]))
    seen = t(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("output"), F.coalesce("text", F.lit("")).alias("neutral"))
    done = augment.outcomes(asked, seen, ["conv_id", "turn"], pv.rule(grants), min_ratio=None)
    return done.select("conv_id", "turn", "mode", "slang", "reason")


@query("SELECT DISTINCT p_type AS control FROM part")
def q58_distinct_controls(spark, sf_dir):
    return dp.distinct_controls(t(spark, sf_dir, "part"), "p_type")


@query(f"""WITH m(intent, control) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lx.EDITOR_CONTROLS.items())}),
l AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'ASSERT_POSITIVE' WHEN 1 THEN 'EXPRESS_STRESS' WHEN 2 THEN 'other' END AS intent FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN text LIKE '%?' THEN text ELSE 'said under ' || coalesce(control, 'ASSERT_NEUTRAL') END) AS new FROM l LEFT JOIN m USING (intent)""")
def q59_editor(spark, sf_dir):
    n = F.col("turn") % 4
    lines = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("utterance"), F.when(n == 0, "ASSERT_POSITIVE").when(n == 1, "EXPRESS_STRESS").when(n == 2, "other").alias("intent"))
    under = F.regexp_extract("prompt_key", r"control: (\S+) \|", 1)
    editor = pv.rule(F.when(F.endswith("prompt_key", F.lit("?")), None).otherwise(F.concat(F.lit("Said, under "), under)))
    told = pv.edit_lines(lines, editor).withColumn("new", F.replace("new", F.lit("Said, under"), F.lit("said under")))
    return told.select("conv_id", "turn", F.md5("new").alias("new"))


@query(rf"""WITH l AS (SELECT {sql_strip("coalesce(text, '')")} AS line FROM conversations) SELECT count(*) AS processed, count(*) FILTER (line LIKE '%?') AS failures FROM l WHERE line <> ''""")
def q60_baseline(spark, sf_dir):
    lines = t(spark, sf_dir, "conversations").select("text")
    done = evaluation.baseline(lines, pv.rule(F.when(~F.endswith("prompt_key", F.lit("?")), F.upper("prompt_key"))))
    return evaluation.baseline_counts(done)


@query("""SELECT 'documents' AS part, doc_id AS id, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT 'conversations', conv_id, NULL, role FROM conversations UNION ALL SELECT 'benchmark', item_id, NULL, NULL FROM benchmark""")
def q61_union_all(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), "lang")
    c = t(spark, sf_dir, "conversations").select("role", F.col("conv_id").alias("id"), F.lit("conversations").alias("part"))
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("part"))
    return relational.union_all(d, c, b)
