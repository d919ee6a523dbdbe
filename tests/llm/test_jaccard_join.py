import random

import numpy as np
import pyarrow as pa

from scenewright.llm import jaccard_join as j


def brute(rows):
    """component of each id, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0D]+", w) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(sets[i]) == j.shingle_set(t.encode() if t else None).size
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and label[a] != label[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((label[a], label[b]))
                    label = {k: lo if v == hi else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one")]
    while len(out) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 6, 8, 9, 12, 20, 35, 60, 63, 64, 65, 130, 300]))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, len(w) // 25])):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["x"], ["y", "z"]])
            out.append((len(out), " ".join(w).title() if r.random() < 0.1 else " ".join(w)))
    return out


class OneSet(j.Sets):
    """Sets that are given."""

    def __init__(self, sets):
        self.s, self.n = np.concatenate(sets), np.array([s.size for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.n)])


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(9)
    for _ in range(500):
        a = np.unique(r.integers(0, 2**64, int(r.integers(5, 3000)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(r.integers(0, a.size // 6 + 1)) :], r.integers(0, 2**64, int(r.integers(0, a.size // 6 + 1)), dtype=np.uint64)]))
        x, y = (np.frombuffer(k, np.uint64).reshape(1, -1) for k in OneSet([a, b]).sketches())
        width = min(x.size, y.size)
        assert not j.linked(a, b) or j.may_link(int(np.bitwise_count(j.fold(x, width) ^ j.fold(y, width)).sum()), a.size, b.size)


def test_many_sets_are_signed_as_each_alone():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in [0, 1, *range(4, 70), 100, 127, 128, 129, 500, 3000, 0]]
    sigs, owner, slack = j.all_signatures(OneSet(sets))
    for k, s in enumerate(sets):
        assert np.array_equal(np.unique(sigs[owner == k]), j.signatures(s))
        code = 0
        for i in j.instances(s.size) if s.size else []:
            code |= j.signatures_of(s, *i)[1]
        assert code == int(slack[k]) % (1 << 64)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(1)
    for _ in range(4000):
        n = int(r.choice([4, 5, 7, 8, 9, 15, 16, 17, 31, 40, 63, 64, 70, 127, 128, 150, 400]))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(r.integers(0, max(1, n // 5) + 1))
        add = int(r.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
        if j.linked(a, b) and not np.array_equal(a, b):
            assert np.intersect1d(j.signatures(a), j.signatures(b)).size, (n, drop, add)


def left_out(s, r):
    """Signatures of a set without as many as its slack allows, in an order that all sets share."""
    sigs, _, slack = j.all_signatures(OneSet([s]))
    tag = sigs & np.uint64(15)
    out = []
    for t in np.unique(tag).tolist():
        own = sigs[tag == np.uint64(t)]
        code = int(slack[0]) >> (16 * (t >> 2)) & 65535
        spare = code >> 2 if code & 3 == t & 3 else 0
        rank = np.argsort(j.mix(own ^ np.uint64(r)))
        out.append(own[rank][spare:])
    return np.concatenate(out) if out else sigs


def test_linked_sets_share_a_signature_whichever_are_left_out():
    r = np.random.default_rng(2)
    seen = 0
    for _ in range(4000):
        n = int(r.choice([8, 9, 15, 16, 17, 31, 40, 63, 64, 70, 127, 128, 150, 200, 300, 400, 511, 512]))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = int(r.integers(0, max(1, n // 5) + 1)), int(r.integers(0, max(1, n // 5) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
        if j.linked(a, b) and not np.array_equal(a, b):
            order = int(r.integers(0, 2**63))
            assert np.intersect1d(left_out(a, order), left_out(b, order)).size, (n, drop, add)
            seen += 1
    assert seen > 500


def test_components_equal_brute_force(spark):
    rows = corpus(420, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({v for _, v in want.values()}) < len(rows) - 60
    for block in (j.BLOCK_NODES, 3):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(df, block_nodes=block).collect()}
        assert got == want


def test_pairs_within_a_bucket_are_those_that_may_be_linked():
    r = np.random.default_rng(5)
    sets = []
    for n in (40, 300, 500, 520, 620, 2000):
        base = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for k in (0, n // 20, n // 10, n // 5):
            sets.append(np.unique(np.concatenate([base[k:], r.integers(0, 2**64, k // 2, dtype=np.uint64)])))
    every = OneSet(sets)
    m = len(sets)
    label, block = np.arange(m) // 2, np.arange(m) % 2
    for own in (True, False):
        a, b = j.pairs_within(label, every.n, every.sketches(), block, own)
        got = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())}
        assert len(got) == a.size
        for x in range(m):
            for y in range(x + 1, m):
                counts = label[x] != label[y] and (own or block[x] != block[y])
                assert counts or (x, y) not in got
                if counts and j.linked(sets[x], sets[y]):
                    assert (x, y) in got


def test_shards_cut_in_steps_and_names_made_anew(spark, monkeypatch):
    rows = corpus(200, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(j, "SHARD_ROWS", 1)
    monkeypatch.setattr(j, "STEP_LOG", 3)
    want = brute(rows)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(df).collect()} == want


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_shingles string")
    assert j.jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", __import__("pyspark").sql.functions.lit(1))
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in j.jaccard_components(df).collect())
    assert got == [("7", 2, 7), ("7", 2, 7), ("9", 0, 9), ("None", 2, 7)]
