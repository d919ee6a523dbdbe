"""Benchmark decontamination by spaced seeds.

Fixed masks select some of the positions of a short token window and ignore the others,
so that a changed token spoils few windows. The masked windows of the benchmark are
hashed into a sorted table; every masked window of every document is looked up in it.
Around each hit the texts are laid side by side and the stretch with the most equal tokens
among those with a sufficient share of them is taken. The masks leave no such stretch out:
without a hit, 12 equal tokens come with more different ones than the share allows.

The benchmark is taken in blocks of a bounded size. A block's table is broadcast and the
documents are passed over once for each block, so any benchmark will do; no pairs are
shuffled and no candidates leave a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, text_bytes, total_bytes
from .license_scan import words_of

# The masks (1: the token counts), each of weight six.
MASKS = ("111111", "11101011", "1101100101", "11001010011", "11011011")
#: Masks for items too short for these, by number of tokens: 1, 2, and from 3 on.
SHORT_MASKS = ("1", "11", "111")
#: A stretch counts with so many equal tokens, or MIN_SHARE of a shorter item's tokens, ...
MIN_EQUAL = 12
#: ... and this share of equal tokens.
MIN_SHARE = 0.8
#: Items with fewer tokens than this count when they stand in a text as they are.
MIN_INEXACT = 6
#: Text of the benchmark in a block, in bytes.
BLOCK_BYTES = 16 << 20
#: Entries of the filter that is asked before the table: a power of two.
FILTER_BITS = 21


def tokens_of(text: bytes | str | None) -> list[bytes]:
    """Words of a text in lower case, also beyond A-Z."""
    if not text:
        return []
    if isinstance(text, bytes):
        text = text if text.isascii() else text.decode("utf-8", "replace")
    return words_of(text.lower().encode() if isinstance(text, str) else text)


def needed(size: int) -> int:
    """Equal tokens that an item of so many tokens needs."""
    return size if size < MIN_INEXACT else min(MIN_EQUAL, -(-size * round(100 * MIN_SHARE) // 100))


def masks_of(size: int) -> list[tuple[int, str]]:
    """Numbers and masks that find an item of so many tokens.

    A shorter item needs fewer than MIN_EQUAL equal tokens, which may leave no more than
    three in a row.
    """
    if not size:
        return []
    if needed(size) < MIN_EQUAL:
        k = min(size, len(SHORT_MASKS)) - 1
        return [(len(MASKS) + k, SHORT_MASKS[k])]
    return list(enumerate(MASKS))


def seeds(hashes: np.ndarray, mask: str, k: int) -> np.ndarray:
    """Hashes of all windows of ``hashes`` under mask number k."""
    n = hashes.size - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The stretch [a, b) with the most equal tokens whose share of them suffices.

    Of several the shortest, then the first; empty where no token is equal.
    """
    count = np.concatenate([[0], np.cumsum(equal)])
    total = count * 100 - np.arange(count.size) * round(100 * MIN_SHARE)
    # For each end the earliest start from which the total does not fall.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    n = count - count[start]
    if not n.any():
        return 0, 0
    ends = np.flatnonzero(n == n.max())
    # The words at either edge that are not equal are no part of a stretch.
    a, b = np.searchsorted(count, count[start[ends]], "right") - 1, np.searchsorted(count, count[ends])
    k = int(np.argmin(b - a))
    return int(a[k]), int(b[k])


class Table:
    """The seeds and tokens of one block of the benchmark."""

    def __init__(self, rows: list[tuple]):
        memo = WordHashes()
        self.items = [r[0] for r in rows]
        self.tokens = [memo.of(tokens_of(r[1])) for r in rows]
        keys, item, place = [], [], []
        for n, t in enumerate(self.tokens):
            for k, mask in masks_of(t.size):
                s = seeds(t, mask, k)
                keys.append(s)
                item.append(np.full(s.size, n, np.int32))
                place.append(np.arange(s.size, dtype=np.int32))
        self.masks = sorted({m for t in self.tokens for m in masks_of(t.size)})
        keys, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (item, np.int32), (place, np.int32)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, tokens: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of all seeds that a text shares with the block."""
        found = set()
        for k, mask in self.masks:
            s = seeds(tokens, mask, k)
            at = np.flatnonzero(self.filter[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if at.size:
                lo, hi = np.searchsorted(self.keys, s[at], "left"), np.searchsorted(self.keys, s[at], "right")
                for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                    found.update(zip(self.item[a:b].tolist(), (p - self.place[a:b]).tolist()))
        return found

    def verify(self, tokens: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """First word, end and equal words of the best stretch on a diagonal, if it counts."""
        t = self.tokens[item]
        lo, hi = max(0, -diagonal), min(t.size, tokens.size - diagonal)
        equal = tokens[lo + diagonal : hi + diagonal] == t[lo:hi]
        a, b = best_stretch(equal)
        n = int(np.count_nonzero(equal[a:b]))
        if b > a and n >= needed(t.size):
            return lo + diagonal + a, lo + diagonal + b, n
        return None

    def overlaps(self, tokens: np.ndarray) -> Iterator[tuple]:
        """(item id, first word, end, equal words, words of the item), the best of each item."""
        best: dict[int, tuple] = {}
        for item, diagonal in sorted(self.hits(tokens)):
            if item in best and best[item][2] == self.tokens[item].size:
                continue  # no other diagonal has more
            got = self.verify(tokens, item, diagonal)
            if got and (item not in best or got[2] > best[item][2]):
                best[item] = got
        for item, (a, b, n) in best.items():
            yield self.items[item], a, b, n, self.tokens[item].size


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """Broadcast tables of the benchmark's blocks, each of a bounded size."""
    sc = benchmark.sparkSession.sparkContext
    _, size = total_bytes(benchmark, text_col)
    n = max(1, -(-size // block_bytes))
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sc.broadcast(pickle.dumps(Table([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()])))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per contaminated document and benchmark item:
    ``id, item_id, first_word, end_word, n_equal, n_item``.

    Words are stretches of digits, letters and non-ASCII characters, without regard to
    case. Of several stretches of one item that with the most equal words, then on
    the smallest diagonal, is given. Null or empty texts match nothing; items of fewer than
    six words match where they stand word by word. Repeated rows give repeated results; other columns are ignored.
    """
    schema = docs.select(F.col(id_col).alias("id")).schema.add("item_id", benchmark.schema[item_col].dataType)
    for name in ("first_word", "end_word", "n_equal", "n_item"):
        schema = schema.add(name, "long")
    raw = docs.select(F.col(id_col).alias("id"), text_bytes(docs, text_col).alias("t"))
    arrow = [("item_id", None), *[(k, pa.int64()) for k in ("first_word", "end_word", "n_equal", "n_item")]]

    def passes(held):
        def run(batches):
            table, memo = pickle.loads(held.value), WordHashes()
            for batch in batches:
                at, rows = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for found in table.overlaps(memo.of(tokens_of(t))):
                        at.append(i)
                        rows.append(found)
                if rows:
                    cols = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *cols], ["id", *[k for k, _ in arrow]])

        return raw.mapInArrow(run, schema)

    out = None
    for held in blocks(benchmark, item_col, item_text_col, block_bytes):
        got = passes(held)
        out = got if out is None else out.unionByName(got)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without those that overlap a benchmark item; columns as they were."""
    for held in blocks(benchmark, item_col, item_text_col, block_bytes):
        place = docs.columns.index(text_col)

        def run(batches, held=held, place=place):
            table, memo = pickle.loads(held.value), WordHashes()
            for batch in batches:
                texts = batch.column(place).to_pylist()
                clean = [next(table.overlaps(memo.of(tokens_of(t))), None) is None for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
