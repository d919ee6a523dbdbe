import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from scenewright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", ["q03_dialogue_lines", "q11_scene_metrics", "q12_script_rollup", "q19_clean_pairs", "q23_slang_pool", "q27_emotion_stress", "q28_gate_decisions", "q32_structural_reasons", "q46_reply_cleanup"])
def test_queries_equal_their_oracles(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    res = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[res.columns.index(c)]) for c in order) for r in res.fetchall()), key=repr)
    assert got == want and got


def test_fold_queries_have_all_outcomes(spark):
    assert {r["gate_stopped"] for r in catalogue.q28_gate_decisions(spark, SF).collect()} == {None, 1, 2, 3}
    moods = catalogue.q27_emotion_stress(spark, SF).collect()
    assert len({r["emotion"] for r in moods}) > 2 and len({r["stress_index"] for r in moods}) > 3
    assert len({r["reason"] for r in catalogue.q32_structural_reasons(spark, SF).collect()}) >= 2


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for f in entry.queries().values():
        assert len(inspect.signature(f).parameters) == 2
