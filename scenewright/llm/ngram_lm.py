"""Language-model scores by a weighted backoff automaton that never stands in one place.

The model: interpolated n-grams, three words at most. A state is a history that was seen
in training; an arc carries the interpolated probability of a word that was seen after it
and leads to the longest history that is then known; a failure arc leads to the history
without its first word and carries what is left. A text is read once from left to right:
the state is carried from word to word, each word takes an arc or fails to a shorter
history, and log-probabilities add up.

The automaton grows with the corpus, so no task holds it. The texts are turned into blocks
of a bounded size, whose words are numbered within the block, and written. Each block asks
shards (by hash range) for the training counts of its distinct n-grams, in packed sorted
arrays; a shard adds up what blocks counted and answers each in its own order. The longest
n-grams are asked for last, and only where the answers so far say that other blocks have
both of their parts, too: the counts of all others are the block's own. From the answers a block compiles the states and arcs that its texts can reach, and walks them.
A frequent n-gram is one entry per block. With more shards than a block fills packs for,
blocks ask in groups, and groups ask finer shards: see ``ask``.

Words and longer n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, mix, release, remove, text_bytes, total_bytes, word_hashes, written

#: Words in the longest n-gram.
ORDER = 3
#: Text in a block, and n-grams in a shard, roughly; n-grams in a byte of text.
BLOCK_BYTES, SHARD_NGRAMS, NGRAMS_PER_BYTE = 3 << 20, 2_000_000, 0.15
#: Shards (as a power of two) that a block asks directly, and blocks (likewise) that ask together beyond that.
STEP_LOG = 9
# What a history's own estimate weighs. For histories of one word, and of two or more: if it was
# seen once, and (start, slope) if more often: start + slope * log2(its count), MOST at most.
ONCE, MORE, MOST = (0.1, 0.5), ((0.2, 0.03), (0.35, 0.04)), 0.8
#: Hashes of the text's end, which is a token, and of its start, which isn't.
END, START = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 7, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest needs, compressed."""
    size = next(k for k in range(1, 9) if k == 8 or int(x.max(initial=0)) < 1 << (8 * k))
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()
    return bytes([size]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expand(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(pa.decompress(b[9:], decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T
    return out.view(np.uint64).ravel()


def pack_keys(x: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b), dtype=np.uint64)


def blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column, block_bytes: int) -> DataFrame:
    """block, ids, held_out, sizes, words, tokens: the texts' words, numbered by how frequent they are in the block."""
    id_type = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), text_bytes(docs, text_col).alias("t"))
    names = ["block", "ids", "held_out", "sizes", "words", "tokens"]

    def row(number: int, ids: list[pa.Array], out: list[pa.Array], hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        words, local, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(order.size)
        own, held = pa.concat_arrays(ids), pa.concat_arrays(out)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        block = TaskContext.get().partitionId() << 32 | number
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), one(own), one(held), one(pa.array(np.concatenate(sizes), pa.int64())), pa.array([words[order].tobytes()]), pa.array([squeeze(rank[local])])], names
        )

    def run(batches):
        number, size, held = 0, 0, ([], [], [], [])
        for batch in batches:
            texts = batch.column(2).to_pylist()
            first, mine = 0, 0
            for k, t in enumerate(texts):
                mine += len(t)
                if size + mine >= block_bytes or k == len(texts) - 1:
                    h, n = word_hashes(texts[first : k + 1])
                    for x, y in zip(held, (batch.column(0).slice(first, k + 1 - first), batch.column(1).slice(first, k + 1 - first), h, n)):
                        x.append(y)
                    size, first, mine = size + mine, k + 1, 0
                    if size >= block_bytes:
                        yield row(number, *held)
                        number, size, held = number + 1, 0, ([], [], [], [])
        if held[0]:
            yield row(number, *held)

    return raw.mapInArrow(run, f"block long, ids array<{id_type}>, held_out array<boolean>, sizes array<long>, words binary, tokens binary")


class Grams:
    """The n-grams of a block: ``of[k]`` numbers the (k + 1)-gram that ends at each place.

    A place is a text's word, its end, or the mark before its first word. ``words[k]`` is
    the last word and ``histories[k]`` the number of all words but the last of each
    distinct (k + 1)-gram, ``keys[k]`` its hash, ``real`` tells places that are tokens.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int):
        v = words.size
        end, start = v, v + 1
        self.width, self.start = v + 2, start
        starts = np.cumsum(sizes + 2) - (sizes + 2)
        x = np.empty(int(sizes.sum()) + 2 * sizes.size, np.int64)
        self.real = np.ones(x.size, bool)
        self.real[starts] = False
        self.first, self.sizes = starts, sizes + 1
        x[starts], x[starts + sizes + 1] = start, end
        inner = self.real.copy()
        inner[starts + sizes + 1] = False
        x[inner] = tokens
        hashes = np.concatenate([words, np.array([END, START], np.uint64)])
        self.token = x
        self.of, self.words, self.histories, self.keys = [x], [np.arange(self.width)], [np.zeros(self.width, np.int64)], [mix(hashes)]
        for _ in range(order - 1):
            before = np.concatenate([[0], self.of[-1][:-1]])
            mark = np.flatnonzero(self.words[-1] == start)  # the n-gram of marks alone precedes a first word's mark
            if mark.size:
                before[starts] = mark[0]
            codes, number = np.unique(before * self.width + x, return_inverse=True)
            history, last = codes // self.width, codes % self.width
            self.of.append(number)
            self.words.append(last)
            self.histories.append(history)
            self.keys.append(mix((self.keys[-1][history] * GOLDEN) ^ hashes[last]))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram stands in the texts with ``train`` set."""
        places = np.repeat(train, self.sizes + 1)
        return [np.bincount(number[places], minlength=k.size) for number, k in zip(self.of, self.keys)]


def share(count: np.ndarray, length: int) -> np.ndarray:
    """What the own estimate of histories of ``length`` words weighs."""
    kind = min(length, len(ONCE)) - 1
    start, slope = MORE[kind]
    return np.where(count <= 1, ONCE[kind], np.minimum(MOST, start + slope * np.log2(np.maximum(count, 1))))


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach.

    ``totals`` are the training counts of the block's n-grams, for each length; ``n`` and
    ``v`` all training tokens and distinct ones. State 0 is the root, the empty history.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int):
        self.width = grams.width
        known = [t > 0 for t in totals]
        histories = totals[:-1]  # an n-gram of the greatest length is no state
        offset = np.cumsum([1] + [t.size for t in histories])
        state = [np.where(k, o + np.arange(k.size), 0) for k, o in zip(known[:-1], offset)]
        self.failure, self.failure_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        weight = np.log10((totals[0] + 1) / (n + v + 1))  # of the arcs from the root; unseen words have one, too
        arcs, weights, targets = [np.arange(self.width)], [weight], [state[0] if state else np.zeros(self.width, np.int64)]
        for k, count in enumerate(histories):
            own = share(count, k + 1)
            shorter = self._suffix(grams, k)
            self.failure.append(state[k - 1][shorter] if k else np.zeros(count.size, np.int64))
            self.failure_weight.append(np.log10(1 - own))
            history, last = grams.histories[k + 1], grams.words[k + 1]
            # What the shorter history gives the word: the weight of the path that fails once.
            below = weight[self._suffix(grams, k + 1)]
            seen = count[history]
            arc = own[history] * totals[k + 1] / np.maximum(seen, 1) + (1 - own[history]) * 10**below
            weight = np.where(seen > 0, np.log10(arc), below)
            hit = known[k + 1]
            arcs.append(state[k][history[hit]] * self.width + last[hit])
            weights.append(weight[hit])
            longest = state[k + 1] if k + 1 < len(histories) else state[k][self._suffix(grams, k + 1)]
            targets.append(longest[hit])
        keys = np.concatenate(arcs)
        by = np.argsort(keys)
        self.arcs, self.weight, self.target = keys[by], np.concatenate(weights)[by], np.concatenate(targets)[by]
        self.failure, self.failure_weight = np.concatenate(self.failure), np.concatenate(self.failure_weight)
        begin = [s[w == grams.start] for s, w in zip(state, grams.words)]
        self.initial = next((int(s[0]) for s in reversed(begin) if s.size and s[0]), 0)

    @staticmethod
    def _suffix(grams: Grams, k: int) -> np.ndarray:
        """The number of each distinct (k + 1)-gram without its first word."""
        out = np.zeros(grams.keys[k].size, np.int64)
        if k:
            out[grams.of[k]] = grams.of[k - 1]
        return out

    def step(self, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that words lead to, and the weights of the failure arcs and arcs taken."""
        weight, state = np.zeros(state.size), state.copy()
        at = np.searchsorted(self.arcs, state * self.width + words)
        lost = np.flatnonzero(self.arcs[np.minimum(at, self.arcs.size - 1)] != state * self.width + words)
        while lost.size:  # the root has an arc for every word
            weight[lost] += self.failure_weight[state[lost]]
            state[lost] = self.failure[state[lost]]
            key = state[lost] * self.width + words[lost]
            at[lost] = np.searchsorted(self.arcs, key)
            lost = lost[self.arcs[np.minimum(at[lost], self.arcs.size - 1)] != key]
        return self.target[at], weight + self.weight[at]

    def walk(self, token: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probabilities of texts, each read from left to right; all walk abreast."""
        order = np.argsort(-sizes, kind="stable")
        begin, ends = first[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))))
        state, total = np.full(sizes.size, self.initial, np.int64), np.zeros(sizes.size)
        for place, n in enumerate(ends.tolist()):  # n texts are longer than that
            state, weight = self.step(state[:n], token[begin[:n] + place])
            total[:n] += weight
        out = np.empty(sizes.size)
        out[order] = total
        return out


ASK_SQL = "block long, shard long, length int, keys binary, counts binary"
ANSWER_SQL = "block long, shard long, length int, totals binary, n long, v long"


def packs(block: int, length: int, keys: np.ndarray, counts: np.ndarray, log: int) -> list[tuple]:
    """Rows of ASK_SQL of sorted keys, a row for each shard that has some."""
    shard = keys >> np.uint64(64 - log)
    cut = np.concatenate([np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))[: keys.size], [keys.size]]).tolist()
    return [(block, int(shard[a]), length, pack_keys(keys[a:b]), squeeze(counts[a:b])) for a, b in zip(cut, cut[1:])]


def asked(rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "shard": pa.int64(), "length": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def answered(blocks_: list, shards: list, lengths: list, totals: list, n: list, v: list) -> pa.Table:
    kinds = {"block": pa.int64(), "shard": pa.int64(), "length": pa.int32(), "totals": pa.binary(), "n": pa.int64(), "v": pa.int64()}
    return pa.table({k: pa.array(x, t) for (k, t), x in zip(kinds.items(), (blocks_, shards, lengths, totals, n, v))})


def grams_of(words: bytes, tokens: bytes, sizes: list[int], order: int) -> Grams:
    return Grams(np.frombuffer(words, np.uint64), expand(tokens).astype(np.int64), np.array(sizes, np.int64), order)


def own_requests(block: int, grams: Grams, own: list[np.ndarray], lengths: range, mask: np.ndarray | None, log: int) -> pa.Table:
    rows = []
    for length in lengths:
        k, c = grams.keys[length - 1], own[length - 1]
        if mask is not None:
            k, c = k[mask], c[mask]
        by = np.argsort(k)
        rows += packs(block, length, k[by], c[by], log)
    return asked(rows)


def requests(table: DataFrame, order: int, log: int) -> DataFrame:
    """What each block asks each shard, and adds to it: all n-grams but the longest."""
    lengths = range(1, max(order, 2))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                grams = grams_of(r["words"], r["tokens"], r["sizes"], max(order - 1, 1))
                yield from own_requests(r["block"], grams, grams.counts(~np.array(r["held_out"], bool)), lengths, None, log).to_batches()

    return table.select("block", "held_out", "sizes", "words", "tokens").mapInArrow(run, ASK_SQL)


def totals_of(grams: Grams, own: list[np.ndarray], found: pa.Table, lengths: range) -> tuple[list[np.ndarray], np.ndarray]:
    """Training counts of n-grams of these lengths, from the answers in the order of shards.

    And which of the longest n-grams may stand in other blocks: their first words do, and their last.
    """
    packed: dict[int, list[np.ndarray]] = {length: [np.zeros(0, np.int64)] for length in lengths}
    for p in found.sort_by("shard").to_pylist():
        packed[p["length"]].append(expand(p["totals"]).astype(np.int64))
    out: list[np.ndarray] = []
    wide, last = np.zeros(0, bool), len(grams.keys)
    for length in range(1, last + 1):
        mask = np.ones(grams.keys[length - 1].size, bool)
        if 1 < length == last:
            mask = wide[grams.histories[length - 1]] & wide[Automaton._suffix(grams, length - 1)]
        if length in lengths:
            at = np.flatnonzero(mask)
            at = at[np.argsort(grams.keys[length - 1][at])]
            got = np.concatenate(packed[length])
            out.append(own[length - 1].copy())
            out[-1][at] = got >> 1
            wide = np.zeros(mask.size, bool)
            wide[at] = got & 1 == 1
    return out, mask


def last_requests(table: DataFrame, found: DataFrame, order: int, log: int) -> DataFrame:
    """The same for the longest n-grams, as far as they may stand in other blocks."""

    def run(texts: pa.Table, answers_: pa.Table) -> pa.Table:
        r = texts.to_pylist()[0]
        grams = grams_of(r["words"], r["tokens"], r["sizes"], order)
        own = grams.counts(~np.array(r["held_out"], bool))
        _, mask = totals_of(grams, own, answers_, range(1, order))
        return own_requests(r["block"], grams, own, range(order, order + 1), mask, log)

    rows = table.select("block", "held_out", "sizes", "words", "tokens")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, ASK_SQL)


def merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The keys of all packs, their counts' sums, whether several packs have them, and where each pack's keys are among them."""
    keys = [unpack_keys(k) for k in t["keys"].to_pylist()]
    union, times = np.unique(np.concatenate(keys), return_counts=True)
    totals, at = np.zeros(union.size, np.int64), [np.searchsorted(union, k) for k in keys]
    for a, c in zip(at, t["counts"].to_pylist()):
        totals[a] += expand(c).astype(np.int64)
    return union, totals, times > 1, at


def answers(asks: DataFrame) -> DataFrame:
    """For every pack's keys twice the totals, and one if other blocks asked, too; and per shard of words a row without block: n, v."""
    start = int(mix(np.array([START], np.uint64))[0])

    def run(t: pa.Table) -> pa.Table:
        length, shard = t["length"][0].as_py(), t["shard"][0].as_py()
        union, totals, wide, at = merged(t)
        words = totals[union != np.uint64(start)] if length == 1 else np.zeros(0, np.int64)
        m = len(at)
        return answered(
            [*t["block"].to_pylist(), None], [shard] * (m + 1), [length] * (m + 1), [*[squeeze(totals[a] << 1 | wide[a]) for a in at], None], [None] * m + [int(words.sum())], [None] * m + [int(np.count_nonzero(words))]
        )

    return asks.groupBy("shard", "length").applyInArrow(run, ANSWER_SQL)


def ask(asks: DataFrame, log: int, total_log: int) -> DataFrame:
    """Answers to the packs of 2**``log`` shards, of which there should be 2**``total_log``.

    Where these are fewer, 2**STEP_LOG blocks and a shard make a group: it adds its blocks'
    packs up, asks 2**STEP_LOG finer shards for the sums as a block of its own, and
    answers its blocks. So a pack has a share of a block's n-grams that doesn't shrink as the corpus
    grows, and a group holds as much as a block does.
    """
    if log >= total_log:
        return answers(asks)
    step = min(STEP_LOG, total_log - log)
    group = F.xxhash64(F.shiftright("block", STEP_LOG), "shard", "length")
    asks = asks.withColumn("group", group)

    def join(t: pa.Table) -> pa.Table:
        union, totals, _, _ = merged(t)
        return asked(packs(t["group"][0].as_py(), t["length"][0].as_py(), union, totals, log + step))

    up = ask(asks.groupBy("group").applyInArrow(join, ASK_SQL), log + step, total_log)

    def split(t: pa.Table, found: pa.Table) -> pa.Table:
        _, _, wide, at = merged(t)
        totals = np.concatenate([expand(x).astype(np.int64) for x in found.sort_by("shard")["totals"].to_pylist()]) | wide
        m = len(at)
        return answered(t["block"].to_pylist(), t["shard"].to_pylist(), t["length"].to_pylist(), [squeeze(totals[a]) for a in at], [None] * m, [None] * m)

    down = asks.groupBy("group").cogroup(up.filter("block is not null").withColumnRenamed("block", "group").groupBy("group")).applyInArrow(split, ANSWER_SQL)
    return down.union(up.filter("block is null"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, held_out: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens: words in lower case (A-Z), cut at white space, and the text's end. Learned
    from all rows for which ``held_out`` (by default by the id's crc32) is false. Null
    text counts as empty: it has one token, its end. ``score`` is the text's log10
    probability by the model of the given order, ``base_score`` by add-one unigrams.
    Repeated rows are learned from repeatedly. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    _, size = total_bytes(docs, text_col)
    total_log = max(4, int(size * NGRAMS_PER_BYTE / SHARD_NGRAMS).bit_length())
    log = min(total_log, STEP_LOG)
    table, table_path = written(blocks(docs, id_col, text_col, is_held_out(id_col) if held_out is None else held_out, block_bytes))

    def answered_(asks: DataFrame) -> tuple[DataFrame, str]:
        path = None
        if log < total_log:  # asked and answered by groups: read twice
            asks, path = written(asks)
        got = written(ask(asks, log, total_log))
        release(spark)
        if path:
            remove(spark, path)
        return got

    got, got_path = answered_(requests(table, order, log))
    paths = [table_path, got_path]
    total = got.filter("block is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    found = got.filter("block is not null").select("block", "shard", "length", "totals")
    if order > 1:
        got, got_path = answered_(last_requests(table, found, order, log))
        paths.append(got_path)
        found = found.union(got.filter("block is not null").select("block", "shard", "length", "totals"))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        r = texts.to_pylist()[0]
        grams = grams_of(r["words"], r["tokens"], r["sizes"], order)
        own = grams.counts(~np.array(r["held_out"], bool))
        counts, _ = totals_of(grams, own, found, range(1, order + 1))
        scores = Automaton(grams, counts, n, v).walk(grams.token, grams.first + 1, grams.sizes)
        times = counts[0][grams.token[grams.real]]
        edges = np.cumsum(grams.sizes) - grams.sizes
        base = np.add.reduceat(np.log10(times + 1), edges) - grams.sizes * math.log10(n + v + 1)
        known = np.add.reduceat((times > 0).astype(np.int64), edges)
        return pa.table(
            {
                "id": texts["ids"].combine_chunks().flatten(), "held_out": texts["held_out"].combine_chunks().flatten(), "n_tokens": pa.array(grams.sizes, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([n] * len(scores), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64()),
            }
        )

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out, _ = written(table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema))
    release(spark)
    for path in paths:
        remove(spark, path)
    return out
