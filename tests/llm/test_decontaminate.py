import random
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

from scenewright.llm import decontaminate as d
from scenewright.llm.common import WordHashes

SF = "/root/testdata/sf0.001"


def brute(table, tokens):
    """Items that overlap, with every diagonal looked at."""
    out = set()
    for n, t in enumerate(table.tokens):
        for diagonal in range(-t.size + 1, tokens.size):
            if table.verify(tokens, n, diagonal):
                out.add(table.items[n])
    return out


def test_seeds_find_what_all_diagonals_find():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    bench = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    table, memo = d.Table([(r["item_id"], r["text"]) for r in bench]), WordHashes()
    hit = 0
    for n, r in enumerate(docs):
        tokens = memo.of(d.tokens_of(r["text"].encode()))
        found = list(table.overlaps(tokens))
        if not found and n >= 30 or hit >= 8:
            continue
        at = found[0][1] if found else 0
        tokens = tokens[max(0, at - 100) : at + 100]
        assert {o[0] for o in table.overlaps(tokens)} == brute(table, tokens)
        hit += bool(found)
    assert hit


def test_substitutions_are_tolerated_and_other_texts_left_alone():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    item = [r.choice(vocabulary) for _ in range(40)]
    table, memo = d.Table([(7, " ".join(item)), (8, ""), (9, None), (10, "one two")]), WordHashes()
    for _ in range(60):
        changed = list(item)
        for i in r.sample(range(40), 5):
            changed[i] = "x"
        text = [r.choice(vocabulary) for _ in range(80)] + changed + [r.choice(vocabulary) for _ in range(80)]
        got = list(table.overlaps(memo.of([w.encode() for w in text])))
        assert [g[0] for g in got] == [7] and abs(got[0][1] - 80) <= 12 and got[0][4] == 40
    for _ in range(100):
        text = [r.choice(vocabulary) for _ in range(300)]
        assert not list(table.overlaps(memo.of([w.encode() for w in text])))
    assert not list(table.overlaps(np.zeros(0, np.uint64)))
    same = memo.of([b"a"] * 500)
    assert not list(table.overlaps(same))


def test_blocks_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in d.overlaps(docs, bench).collect()}
    many = {tuple(r) for r in d.overlaps(docs, bench, block_bytes=2500).collect()}
    assert one == many
    clean = {r[0] for r in d.decontaminate(docs, bench, block_bytes=2500).select("doc_id").collect()}
    assert clean == {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in one}
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert d.overlaps(odd, bench).count() == 0 and d.decontaminate(odd, bench).count() == 3
    assert d.overlaps(docs.filter("false"), bench).count() == 0
    assert d.overlaps(docs, bench.filter("false")).count() == 0


def stretches(equal):
    """(equal words, first, end) of all stretches with 80 % equal words."""
    e = [bool(x) for x in equal]
    return [(sum(e[a:b]), a, b) for a in range(len(e)) for b in range(a + 1, len(e) + 1) if 5 * sum(e[a:b]) >= 4 * (b - a)]


def test_the_stretch_with_most_equal_words_decides():
    r = random.Random(5)
    for _ in range(400):
        equal = np.array([r.random() < r.choice((0.5, 0.8, 0.9)) for _ in range(r.randint(0, 40))], bool)
        a, b = d.best_stretch(equal)
        most = max((n for n, _, _ in stretches(equal)), default=0)
        assert int(equal[a:b].sum()) == most and 5 * most >= 4 * (b - a)
        assert b - a == min((y - x for n, x, y in stretches(equal) if n == most and n), default=0)


def test_every_copy_that_meets_the_rule_is_found():
    item = [f"w{i}" for i in range(59)]
    memo = WordHashes()
    around = [f"o{i}" for i in range(20)]

    def found(size, changed):
        table = d.Table([(1, " ".join(item[:size]))])
        text = around + ["x" if i in changed else w for i, w in enumerate(item[:size])] + around
        return list(table.overlaps(memo.of([w.encode() for w in text])))

    # Words 12 and 13 of 16, words 3 and 13 of 15.
    assert found(16, {11, 12}) == [(1, 20, 36, 14, 16)]
    assert found(15, {2, 12}) == [(1, 20, 35, 13, 15)]
    for changed in combinations(range(15), 3):
        assert [o[3] for o in found(15, changed)] == [12], changed
    r = random.Random(6)
    for _ in range(600):
        size = r.randint(16, 59)
        changed = r.sample(range(size), size // 5)
        assert [o[3] >= size - len(changed) for o in found(size, changed)] == [True], changed


def test_masks_leave_no_stretch_out():
    """The most equal words of alignments of up to 60 words that no mask hits, by their last ten words."""
    masks = [(len(m), int(m, 2)) for m in d.MASKS]
    most = {(0, 0): 0}
    for size in range(1, 61):
        after = {}
        for (bits, known), n in most.items():
            for bit in (0, 1):
                now, length = bits << 1 | bit, known + 1
                if not any(length >= k and now & m == m for k, m in masks):
                    state = now & 1023, min(10, length)
                    after[state] = max(after.get(state, 0), n + bit)
        most = after
        assert not max(most.values()) >= max(d.MIN_EQUAL, d.MIN_SHARE * size)


def test_short_items():
    memo = WordHashes()
    around = [f"o{i}" for i in range(9)]

    def found(words, text):
        table = d.Table([(1, " ".join(words)), (2, None), (3, "")])
        return list(table.overlaps(memo.of([w.encode() for w in text])))

    for size in range(1, 6):
        item = [f"w{i}" for i in range(size)]
        assert found(item, around + item + around + item) == [(1, 9, 9 + size, size, size)]
        assert not found(item, around + item[:-1] + around + item[1:])
        assert not found(item, [])
    for size in range(6, 15):
        item, allowed = [f"w{i}" for i in range(size)], size // 5
        for n in (0, allowed, allowed + 1):
            for changed in combinations(range(size), n):
                got = found(item, around + ["x" if i in changed else w for i, w in enumerate(item)] + around)
                assert bool(got) == (n <= allowed), (size, changed)
                assert not got or got[0][3] == size - n
    assert found(["the"], ["the"] * 500) == [(1, 0, 1, 1, 1)]
