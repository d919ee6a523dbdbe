"""Licence scan with a generalised suffix automaton of licence tokens.

One automaton holds the words of all templates. A file's words stream through it once
and give matching statistics: for each place, the longest stretch ending there that
stands in some template. Stretches that can't be extended and are long enough are chained,
per template and in both orders, into covered template spans; a template whose covered
share is large enough gives the file its label. Base phrases are templates of their own:
a place counts where the whole phrase is a suffix of the current match.

The templates are constants of a fixed size, so the automaton is shipped with the task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, text_bytes

#: Shortest stretch that a chain is made of, in words.
MIN_MATCH = 5
#: Words between two stretches of one chain, in the file and in the template, at most.
MAX_GAP = 12
#: Share of a template that a chain must cover for its label.
MIN_COVER = 0.5

# Phrases whose places are counted, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public licence texts and notices, and their labels.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Everything that isn't a word byte: ASCII but digits and letters.
_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words: stretches of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.lower().translate(_SPLIT).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(dict(arcs))
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of exactly the strings of p and w, cut off from q."""
        clone = self._new(self.length[p] + 1, self.next[q], self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new


class Scanner:
    """The automaton of a set of templates and phrases, and what it finds in a text."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        texts = [words_of(t.encode()) for _, t in templates] + [words_of(p.encode()) for p, _ in phrases]
        self.labels = [k for k, _ in templates] + [k for _, k in phrases]
        self.n_templates, self.sizes = len(templates), [len(t) for t in texts]
        self.ids: dict[bytes, int] = {}
        for t in texts:
            for w in t:
                self.ids.setdefault(w, len(self.ids))
        self.auto = Automaton([[self.ids[w] for w in t] for t in texts])
        self.shortest = min([min_match, *self.sizes[self.n_templates :]])
        #: For each state the phrases that end there, with the match length that takes.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.auto.length]
        for v, ends in enumerate(self.auto.ends):
            for k, end in ends:
                if k >= self.n_templates and end == self.sizes[k] and self.auto.length[v] >= end:
                    self.phrases[v].append((k, end))
        for v in sorted(range(1, len(self.auto.length)), key=lambda v: self.auto.length[v]):
            up = self.phrases[self.auto.link[v]]
            self.phrases[v] += [x for x in up if x not in self.phrases[v]]
        self.memo: dict[bytes, int] = _Ids(self.ids)

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Stretches of template words that are long enough to matter: start and ids."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = _Ids(self.ids)
        ids = np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a >= self.shortest:
                yield a, ids[a:b].tolist()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases (start, phrase) and maximal matches (end, length, state)."""
        nxt, link, length = self.auto.next, self.auto.link, self.auto.length
        places, matches = [], []
        for at, ids in self.runs(words):
            v = n = 0
            for i, w in enumerate(ids):
                to = nxt[v].get(w)
                if to is None:
                    if n >= self.min_match:
                        matches.append((at + i, n, v))
                    while v and w not in nxt[v]:
                        v = link[v]
                        n = length[v]
                    to = nxt[v].get(w)
                    if to is None:
                        continue
                v, n = to, n + 1
                for k, size in self.phrases[v]:
                    if n >= size:
                        places.append((at + i + 1 - size, k))
            if n >= self.min_match:
                matches.append((at + len(ids), n, v))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains (template, first word, end, covered words) of matches in file order.

        A match extends a chain if it lies after it in file and template and leaves at
        most ``max_gap`` words on both sides; words matched twice count once.
        """
        done, live = [], {}
        for end, n, v in sorted(matches, key=lambda m: (m[0] - m[1], m[0])):
            start = end - n
            for k, t_end in self.auto.ends[v]:
                if k >= self.n_templates:
                    continue
                t_start = t_end - n
                open_ = [c for c in live.get(k, ()) if start - c[1] <= self.max_gap]
                done += [(k, c[0], c[1], c[3]) for c in live.get(k, ()) if start - c[1] > self.max_gap]
                best = None
                for c in open_:
                    over = max(0, c[1] - start, c[2] - t_start)
                    if over < n and t_start - c[2] <= self.max_gap and t_end > c[2] and end > c[1] and (best is None or c[3] - over > best[0]):
                        best = c[3] - over, c, over
                if best is None:
                    open_.append([start, end, t_end, n])
                else:
                    best[1][1:] = [end, t_end, best[1][3] + n - best[2]]
                live[k] = open_
        return done + [(k, c[0], c[1], c[3]) for k, cs in live.items() for c in cs]

    def report(self, words: list[bytes]) -> dict:
        """What a text holds: phrases' places, covered spans, labels and a score."""
        places, matches = self.scan(words)
        spans = [(self.labels[k], a, b, min(1.0, n / self.sizes[k])) for k, a, b, n in self.chains(matches)]
        spans = [s for s in spans if s[3] >= self.min_cover]
        starts = [a for a, _ in places]
        base = {self.labels[k] for _, k in places}
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": float(max([1.0] * bool(places) + [s[3] for s in spans], default=0.0)),
            "spans": [{"label": k, "first_word": a, "end_word": b, "cover": c} for k, a, b, c in sorted(spans)],
        }


class _Ids(dict):
    """Memo word -> id, -1 for words of no template."""

    def __missing__(self, word: bytes) -> int:
        self[word] = -1
        return -1


@functools.lru_cache(maxsize=2)
def scanner(*settings) -> Scanner:
    return Scanner(*settings)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))
FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER) -> DataFrame:
    """One row per input row: id, counts and places of base phrases, labels, score, spans.

    ``spans`` lists the covered spans (label, first word, end, share of the template).
    Null and empty texts have no words, no labels and score 0. Rows are scanned one by
    one, so ties, repeated rows and other columns don't matter.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    settings = (templates, phrases, min_match, max_gap, min_cover)

    def run(batches):
        s = scanner(*settings)
        for batch in batches:
            found = [s.report(words_of(t)) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in found], t) for k, t in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *[k for k, _ in FIELDS]])

    schema = (
        f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first_word: long, end_word: long, cover: double>>"
    )
    return docs.select(F.col(id_col).alias("id"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, schema)

