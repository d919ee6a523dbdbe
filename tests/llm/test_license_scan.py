import random
import re

import pyarrow.parquet as pq

from scenewright.llm.license_scan import PHRASES, TEMPLATES, Automaton, Scanner, words_of


def naive_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def naive_places(text):
    words, out = naive_words(text), []
    for p, label in PHRASES:
        p = p.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def longest_stretches(seqs, ids):
    """Matching statistics the plain way."""
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(ids[i + 1 - n : i + 1]) in subs), default=0) for i in range(len(ids))]


def test_automaton_gives_matching_statistics():
    r = random.Random(3)
    for _ in range(60):
        seqs = [[r.randrange(4) for _ in range(r.randint(1, 9))] for _ in range(3)]
        ids = [r.randrange(5) for _ in range(25)]
        a, v, n, got = Automaton(seqs), 0, 0, []
        for w in ids:
            while v and w not in a.next[v]:
                v = a.link[v]
                n = a.length[v]
            v, n = (a.next[v][w], n + 1) if w in a.next[v] else (0, 0)
            got.append(n)
        assert got == longest_stretches(seqs, ids)


def test_places_equal_the_plain_way():
    s, r = Scanner(), random.Random(5)
    bits = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "Apache License, Version 2.0", "CC-BY-NC", "x", "é"]
    texts = ["", None, "cc by nc by nc", "CC by\nnc"] + [" ".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    found = 0
    for t in texts:
        words = words_of(t.encode() if t else None)
        assert [w.decode() for w in words] == naive_words(t)
        got = s.report(words)
        want = naive_places(t)
        found += len(want)
        assert got["n_base"] == len(want)
        assert got["first_word"] == (want[0][0] if want else None)
        assert got["last_word"] == (want[-1][0] if want else None)
        assert got["base_labels"] == ",".join(sorted({k for _, k in want}))
        assert set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
    assert found > 100


def test_templates_are_found_with_changes_inside():
    s = Scanner()
    for label, text in TEMPLATES:
        words = words_of(("foo bar " + text + " baz qux").encode())
        got = s.report(words)
        assert label in got["labels"].split(",") and got["score"] == 1.0, label
    mit = dict(TEMPLATES)["mit"].split()
    mit[20:22] = ["another", "word"]
    got = s.report(words_of(" ".join(mit).encode()))
    assert got["labels"] == "mit" and 0.9 < got["score"] < 1
    assert s.report(words_of(b"the software and the work of this and that"))["labels"] == ""
