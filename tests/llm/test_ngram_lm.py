import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scenewright.llm import ngram_lm as lm


def brute(rows, order):
    """The backoff automaton with dictionaries, one token at a time."""
    def tokens(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t) + ["\0end"]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    grams = [Counter() for _ in range(order)]
    for i, t in rows:
        if not held[i]:
            padded = ["\0start"] * (order - 1) + tokens(t)
            for at in range(len(padded)):
                for k in range(order):
                    again = k == 0 and at < order - 2  # a text's first words have one start before them
                    if at - k >= 0 and (at >= order - 1 or k < order - 1) and not again:
                        grams[k][tuple(padded[at - k : at + 1])] += 1
    words = {w: c for (w,), c in grams[0].items() if w != "\0start"}
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in rows:
        own, score = tokens(t), 0.0
        state = ["\0start"] * (order - 1)
        for w in own:
            h = list(state)
            while h and not grams[len(h) - 1][tuple(h)]:
                h = h[1:]

            def p(h):
                if not h:
                    return (words.get(w, 0) + 1) / (n + v + 1)
                c = grams[len(h) - 1][tuple(h)]
                start, slope = lm.MORE[min(len(h), 2) - 1]
                share = lm.ONCE[min(len(h), 2) - 1] if c == 1 else min(lm.MOST, start + slope * math.log2(c))
                return share * grams[len(h)][(*h, w)] / c + (1 - share) * p(h[1:])

            score += math.log10(p(h))
            state = (state + [w])[1:] if order > 1 else []
        base = sum(math.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in own)
        out.append((i, held[i], len(own), sum(w in words for w in own), n, base, score))
    return out


@pytest.mark.parametrize(("order", "grouped"), [(1, False), (2, False), (3, False), (3, True)])
def test_scores_equal_brute_force(spark, order, grouped, monkeypatch):
    if grouped:  # blocks ask in groups, and groups in groups
        monkeypatch.setattr(lm, "STEP_LOG", 2)
        monkeypatch.setattr(lm, "SHARD_NGRAMS", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(70)
    rows = [tuple(r) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "new WORD\x0bhere"), (None, "the of")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    got, want = sorted(map(tuple, lm.lm_scores(df, order=order, block_bytes=20_000).collect()), key=key), sorted(brute(rows, order), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    if order == 1:
        assert all(g[5] == pytest.approx(g[6]) for g in got)


def test_empty_table(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string, block string")).count() == 0


def test_better_than_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.lm_scores(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r["s"] > r["b"] * 0.97
    assert r["s"] / r["n"] > -3.25


def test_the_state_carried_is_the_longest_history_that_was_seen():
    r = np.random.default_rng(4)
    sizes = np.array([0, 1, 2, 30, 200, 3, 200])
    words = np.unique(r.integers(0, 2**64, 12, dtype=np.uint64))
    grams = lm.Grams(words, r.integers(0, words.size, int(sizes.sum())), sizes, 3)
    train = np.array([True, False, True, True, False, True, True])
    totals = grams.counts(train)
    automaton = lm.Automaton(grams, totals, 500, 12)
    offset = [1, 1 + totals[0].size]
    longest = 0
    for a, m in zip(grams.first.tolist(), grams.sizes.tolist()):
        state = automaton.initial
        for place in range(a + 1, a + 1 + m):
            # The history before this place: two words if they were seen in training, else one, else none.
            one, two = int(grams.of[0][place - 1]), int(grams.of[1][place - 1])
            want = offset[1] + two if totals[1][two] else offset[0] + one if totals[0][one] else 0
            assert state == want
            state = int(automaton.step(np.array([state]), grams.token[place : place + 1])[0][0])
            longest += want >= offset[1]
    assert longest > 100
