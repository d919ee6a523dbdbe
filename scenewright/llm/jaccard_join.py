"""Similarity join of word-shingle sets with PartEnum signatures.

Two sets with Jaccard similarity of 4/5 or more differ in at most (|r| + |s|) / 9
elements. The sets are put into bands of sizes; within a band, and across each border
between bands, the number of differences is at most some d. The domain of shingles is cut
into more than d partitions, so two such sets agree on at least one partition, and a hash
of a partition's content is their common signature. An empty partition says nothing: a
set with so few non-empty partitions that agreement on one of them isn't certain is signed
again under other partitionings, and signs its empty partitions under the last one only.
So no linked pair is lost.

Most sets agree on many more partitions than one with all that they are linked with: on at
least r. Whichever order the signatures have, two sets that share r of them still share one
when either leaves out its r - 1 first. Half of this slack spares signatures (those of the
last partitions), half spares work: of each set the signatures that most sets have, such
as those of common passages, are left out once all counts are known.

Equal sets are one *node*. Steps:

1. one pass over the texts makes nodes, sketches and signatures; signatures travel packed,
   sorted by hash, to shards of a bounded size, which return those that two nodes share;
2. each node leaves out its most frequent signatures, as said above;
3. each bucket's smallest node is its pivot. Every node is compared with its smallest
   pivot, then with those pivots that it isn't connected with;
4. buckets whose nodes aren't all connected by then are compared within, in blocks of a
   bounded number of nodes; only pairs of nodes that aren't connected count;
5. connected components of the links.

Parity sketches (a lower bound of the difference, with more bins for larger sets) rule
pairs out before sets are fetched; only documents with a pair that is left are read for
their sets, and verified exactly. Nodes are told apart by 128 bits of a hash; 64 of them
are the node's name, and should two sets ever share a name all are named anew.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GOLDEN, mix, release, remove, text_bytes, total_bytes, word_hashes, written

#: Words in a shingle.
SHINGLE = 5
#: Similarity: NUM * intersection >= DEN * union, in hundredths.
THRESHOLD = 80
#: Partitionings a set is signed under at most.
SEEDS = 4
#: Bits of the bitmap of wanted documents, at most (32 MB).
BITMAP_LOG = 28
#: Signatures a task gathers before it sends them off, those of one shard, and rows of one shard.
CHUNK_SIGNATURES, SHARD_SIGNATURES, SHARD_ROWS = 500_000, 1_000_000, 100_000
#: Signatures in a byte of text, roughly: decides the number of shards only.
SIGNATURES_PER_BYTE = 0.08
#: Shards (as a power of two) that a chunk is cut into at once; more are made in several steps.
STEP_LOG = 9
#: Nodes in a block.
BLOCK_NODES = 2048
#: Bytes of the smallest parity sketch.
SKETCH_BYTES = 128
#: Text that is turned into sets at once.
SLICE_BYTES = 1 << 19


def combine(h: np.ndarray, size: int, m: int) -> np.ndarray:
    """Hashes of the ``m`` runs of ``size`` words that start at the first words."""
    out = np.full(m, size, np.uint64)
    for j in range(size):
        out = (out ^ h[j : j + m]) * GOLDEN
        out ^= out >> np.uint64(29)
    return out


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; shorter texts are one shingle."""
    h, _ = word_hashes([text])
    if not h.size:
        return np.zeros(0, np.uint64)
    size = min(h.size, SHINGLE)
    return np.unique(combine(h, size, h.size - size + 1))


class Sets:
    """The sets of some texts, laid end to end: text k has ``s[at[k] : at[k + 1]]``, sorted."""

    def __init__(self, texts: list[bytes | None]):
        h, counts = word_hashes(texts)
        ends = np.cumsum(counts)
        m = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
        at = np.concatenate([[0], np.cumsum(m)])
        out = np.zeros(at[-1], np.uint64)
        if h.size >= SHINGLE:
            left = np.repeat(ends, counts) - np.arange(h.size)
            out[np.repeat(counts >= SHINGLE, m)] = combine(h, SHINGLE, h.size - SHINGLE + 1)[left[: h.size - SHINGLE + 1] >= SHINGLE]
        for k in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
            out[at[k]] = combine(h[ends[k] - counts[k] : ends[k]], int(counts[k]), 1)[0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            out[a:b].sort()
        fresh = np.ones(out.size, bool)
        fresh[1:] = out[1:] != out[:-1]
        fresh[at[:-1][m > 0]] = True
        self.s = out[fresh]
        self.at = np.concatenate([[0], np.cumsum(fresh)])[at]
        self.n = np.diff(self.at)

    def of(self, k: int) -> np.ndarray:
        return self.s[self.at[k] : self.at[k + 1]]

    def names(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Two signed 64-bit hashes of each set: its node's name, and what tells nodes of one name apart."""
        raw = b"".join(xxhash.xxh3_128_digest(self.of(k).tobytes(), seed) for k in range(self.n.size))
        both = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def sketches(self) -> list[bytes]:
        """For each set, for each of a number of bins that grows with it, whether it has an odd number of elements there."""
        bits = 8 * np.array([sketch_bytes(int(n)) for n in self.n], np.int64)
        start = np.concatenate([[0], np.cumsum(bits)])
        bins = (mix(self.s) >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, self.n)
        odd = np.bincount(bins + np.repeat(start[:-1], self.n), minlength=int(start[-1])) & 1
        raw = np.packbits(odd.astype(np.uint8)).tobytes()
        return [raw[a // 8 : b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def slices(texts: list[bytes | None]):
    """(first, end) of runs of texts of some SLICE_BYTES."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def most_different(total: int) -> int:
    """The most elements in which two linked sets of ``total`` elements together differ."""
    return total * (100 - THRESHOLD) // (100 + THRESHOLD)


def largest_partner(n: int) -> int:
    return n * 100 // THRESHOLD


@lru_cache(maxsize=100_000)
def instances(n: int) -> list[tuple[int, int, int]]:
    """(instance, partitions, most differences) in which a set of ``n`` elements is signed.

    Band j has the sizes from 2**j up to 2**(j + 1); instance 2j joins the sets of band j,
    instance 2j + 1 those of both sides of its upper border.
    """
    out = []
    band = n.bit_length() - 1
    for j in (band - 1, band):
        top = 1 << (j + 1)  # the border
        across = largest_partner(top - 1)
        if j == band:
            worst, mine = most_different(2 * top - 2), most_different(n + min(top - 1, largest_partner(n)))
            out.append((2 * j, worst, mine))
        if n <= across and largest_partner(n) >= top:
            mine = most_different(n + min(largest_partner(n), across))
            out.append((2 * j + 1, most_different(top - 1 + across), mine))
    # Sets that may not differ at all are one node; they need no signature.
    return [(k, worst + 1 + (worst + 9) // 10, mine) for k, worst, mine in out if worst and mine]


def tagged(sigs: np.ndarray, instance: int | np.ndarray, seed: int) -> np.ndarray:
    """Signatures whose last four bits tell the instance (a set has neighbouring ones only) and the seed."""
    return (sigs & np.uint64(0xFFFFFFFFFFFFFFF0)) | np.uint64(seed) | (np.asarray(instance, np.uint64) & np.uint64(3)) << np.uint64(2)


def base_of(instance: int, seed: int) -> int:
    return (instance * SEEDS + seed + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF


def slack_code(r: int, spared: int, instance: int, seed: int) -> int:
    """How many more signatures of an instance may be left out, and its last seed: 16 bits for each tag."""
    return (min(max(0, r - 1 - spared), (1 << 13) - 1) << 2 | seed) << (16 * (instance & 3))


def signatures_of(s: np.ndarray, instance: int, parts: int, most: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in one instance, and its slack."""
    out = []
    for seed in range(SEEDS):
        h = mix(s ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if seed else s
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        if seed:
            order = np.argsort(part, kind="stable")
            h, part = h[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(mix(h + GOLDEN), first)
        base = np.uint64(base_of(instance, seed))
        r = first.size - most  # non-empty partitions on which it agrees with any linked set, at least
        spared = max(0, (r - 1) // 2)
        out.append(tagged(mix(mix(part[first] + base) ^ content)[: first.size - spared], instance, seed))
        if r >= 1:
            break
        if seed == SEEDS - 1:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
            out.append(tagged(mix(mix(empty + base)), instance, seed))
    return np.concatenate(out), slack_code(r, spared, instance, seed)


def signatures(s: np.ndarray) -> np.ndarray:
    """All signatures of a set."""
    out = [signatures_of(s, *i)[0] for i in instances(s.size)] if s.size else []
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def all_signatures(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, the set of each, the slack of each set): ``signatures_of`` for many sets at once."""
    slack = np.zeros(sets.n.size, np.int64)
    lists = [instances(n) if n else [] for n in sets.n.tolist()]
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for slot in range(max(map(len, lists), default=0)):
        k = np.array([i for i, x in enumerate(lists) if len(x) > slot], np.int64)
        instance, parts, most = np.array([lists[i][slot] for i in k.tolist()], np.int64).T
        n = sets.n[k]
        job = np.repeat(np.arange(k.size), n)
        h = sets.s[np.arange(job.size) + np.repeat(sets.at[k] - (np.cumsum(n) - n), n)]
        part = ((h >> np.uint64(32)) * parts.astype(np.uint64)[job]) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (job[1:] != job[:-1])]))
        content = np.add.reduceat(mix(h + GOLDEN), first)
        own = job[first]
        base = np.array([base_of(i, 0) for i in instance.tolist()], np.uint64)
        got = tagged(mix(mix(part[first] + base[own]) ^ content), instance[own], 0)
        filled = np.bincount(own, minlength=k.size)
        r = filled - most
        spared = np.maximum(0, (r - 1) // 2)
        keep = (r[own] >= 1) & (np.arange(own.size) < (np.cumsum(filled) - spared)[own])
        sigs.append(got[keep])
        owners.append(k[own[keep]])
        left = np.minimum(np.maximum(0, r - 1 - spared), (1 << 13) - 1) << 2
        sure = r >= 1
        slack[k[sure]] |= left[sure] << (16 * (instance[sure] & 3))
        for x in np.flatnonzero(~sure).tolist():
            more, code = signatures_of(sets.of(int(k[x])), int(instance[x]), int(parts[x]), int(most[x]))
            sigs.append(more)
            owners.append(np.full(more.size, k[x], np.int64))
            slack[k[x]] |= code
    return np.concatenate(sigs), np.concatenate(owners), slack


def sketch_bytes(n: int) -> int:
    """Bytes of a set's sketch: two bins or more for each element."""
    return max(SKETCH_BYTES, 1 << max(0, (2 * n - 1).bit_length() - 3)) if n else 0


def fold(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row each, of 64-bit words) brought down to ``width`` words."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def may_link(apart, na, nb):
    """Whether sets of these sizes whose sketches differ in ``apart`` bins may be linked; for numbers, arrays and columns."""
    return (apart * (100 + THRESHOLD) <= (na + nb) * (100 - THRESHOLD)) & (na * 100 >= nb * THRESHOLD) & (nb * 100 >= na * THRESHOLD)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if a.size * 100 < b.size * THRESHOLD or b.size * 100 < a.size * THRESHOLD:
        return False
    if a.size > b.size:
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, b.size - 1)] == a))
    return 100 * both >= THRESHOLD * (a.size + b.size - both)


def bits_of(bitmap: np.ndarray, log: int, h: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned hashes are set."""
    at = h >> np.uint64(64 - log)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart: the shuffle's compression takes out the empty planes."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


#: Columns of rows that travel together, and their types (id's apart): of a document, of a pack, of a shared signature.
KINDS = {"n": pa.int64(), "node": pa.int64(), "other": pa.int64(), "sketch": pa.binary(), "slack": pa.int64(), "shard": pa.int64(), "sigs": pa.binary(), "nodes": pa.binary(), "sig": pa.int64(), "m": pa.int64()}
KIND_SQL = "n long, node long, other long, sketch binary, slack long, shard long, sigs binary, nodes binary, sig long, m long"


def rows_of(id_arrow: pa.DataType, size: int, **arrays) -> pa.RecordBatch:
    kinds = {"id": id_arrow} | KINDS
    return pa.RecordBatch.from_arrays([arrays.get(k, pa.nulls(size, t)) for k, t in kinds.items()], list(kinds))


def packs(sigs: np.ndarray, nodes: np.ndarray, log: int, id_arrow: pa.DataType) -> pa.RecordBatch:
    """A pack for each shard that has some of the signatures."""
    order = np.argsort(sigs)
    sigs, nodes = sigs[order], nodes[order]
    shard = (sigs >> np.uint64(64 - log)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = [*cut[1:].tolist(), sigs.size]
    both = [(pack_sorted(sigs[a:b]), nodes[a:b].tobytes()) for a, b in zip(cut.tolist(), ends)]
    return rows_of(id_arrow, cut.size, shard=pa.array(shard[cut]), sigs=pa.array([x for x, _ in both], pa.binary()), nodes=pa.array([y for _, y in both], pa.binary()))


def unpacked(sigs: list[bytes], nodes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([unpack_sorted(x) for x in sigs]), np.concatenate([np.frombuffer(x, np.int64) for x in nodes])


def read_once(docs: DataFrame, id_col: str, text_col: str, log: int, seed: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    Per document: id, n, and the node, sketch and slack of its set (none for an empty
    set), dealt to all shards. Per chunk of documents and shard: packed signatures.
    """

    def run(batches):
        seen, held, size, kind, times = set(), [], 0, None, {}
        for batch in batches:
            kind, texts = batch.column(0).type, batch.column(2).to_pylist()
            hashes = batch.column(1).to_numpy()
            for a, b in slices(texts):
                sets = Sets(texts[a:b])
                name, other = sets.names(seed)
                sigs, owner, slack = all_signatures(sets)
                none = pa.array(sets.n == 0)
                value = lambda x: pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(x))  # noqa: E731, B023
                deal = hashes[a:b] ^ name
                for k, x in enumerate(deal.tolist()):  # rows that repeat id and text go apart, in whichever order they come
                    times[x] = again = times.get(x, -1) + 1
                    deal[k] ^= again
                shard = pa.array((mix(deal.view(np.uint64)) >> np.uint64(64 - log)).astype(np.int64))
                yield rows_of(kind, b - a, id=batch.column(0).slice(a, b - a), n=pa.array(sets.n), node=value(name), other=value(other), sketch=pa.array(sets.sketches(), pa.binary()), slack=pa.array(slack), shard=shard)
                fresh = np.zeros(b - a, bool)
                for k, x in enumerate(name.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                take = fresh[owner]
                held.append((sigs[take], name[owner[take]]))
                size += held[-1][0].size
                if size >= CHUNK_SIGNATURES:
                    yield packs(*map(np.concatenate, zip(*held)), log=min(log, STEP_LOG), id_arrow=kind)
                    held, size, seen = [], 0, set()
        if size:
            yield packs(*map(np.concatenate, zip(*held)), log=min(log, STEP_LOG), id_arrow=kind)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {KIND_SQL}"
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, schema)


def finer(rows: DataFrame, log: int) -> DataFrame:
    """Packs of coarse shards, gathered by shard, cut into finer ones; other rows as they are."""

    def run(batches):
        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            is_pack = pa.compute.is_valid(batch.column("sigs"))
            yield batch.filter(pa.compute.invert(is_pack))
            mine = batch.filter(is_pack)
            for x, y in zip(mine.column("sigs").to_pylist(), mine.column("nodes").to_pylist()):
                held.append((unpack_sorted(x), np.frombuffer(y, np.int64)))
                size += held[-1][0].size
                if size >= CHUNK_SIGNATURES:
                    yield packs(*map(np.concatenate, zip(*held)), log=log, id_arrow=kind)
                    held, size = [], 0
        if size:
            yield packs(*map(np.concatenate, zip(*held)), log=log, id_arrow=kind)

    return rows.repartition("shard").mapInArrow(run, rows.schema)


def shared(rows: DataFrame) -> DataFrame:
    """The documents' rows as they are, and sig, node, m of all signatures that m > 1 nodes have."""
    names = rows.columns

    def run(t: pa.Table) -> pa.Table:
        is_pack = pa.compute.is_valid(t["sigs"])
        own, mine = t.filter(pa.compute.invert(is_pack)), t.filter(is_pack)
        if not mine.num_rows:
            return own
        sig, node = unpacked(mine["sigs"].to_pylist(), mine["nodes"].to_pylist())
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        same = sig[1:] == sig[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        sig, node = sig[twice], node[twice]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        if sig.size:
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            sig, node = sig[fresh], node[fresh]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            m = np.diff(np.concatenate([first, [sig.size]]))
            m = np.repeat(m, m)
            sig, node, m = sig[m > 1], node[m > 1], m[m > 1]
        else:
            m = np.zeros(0, np.int64)
        found = rows_of(t.schema.field("id").type, sig.size, node=pa.array(node), sig=pa.array(sig.view(np.int64)), m=pa.array(m))
        return pa.concat_tables([own, pa.Table.from_batches([found])]).select(names)

    return rows.groupBy("shard").applyInArrow(run, rows.schema)


def bitmap_of(hashes: DataFrame, log: int) -> bytes:
    """The bitmap of 2**log bits of a column ``h`` of signed hashes, made by built-in aggregates."""
    position = F.shiftrightunsigned("h", 64 - log)
    rows = hashes.select((position / 32768).cast("long").alias("k"), (position % 32768).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = bytearray(1 << (log - 3))
    for r in rows.collect():
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = bytes(r["bits"])
    return bytes(out)


def fetch_sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """node, elements of the wanted nodes; some others may be among them.

    ``nodes`` (node, first) tells a document that has the node's set. A bitmap of those
    documents' ids is asked before a text is read at all, and one of ids and nodes
    thereafter; hits by chance do no harm.
    """
    spark = docs.sparkSession
    chosen, path = written(nodes.join(wanted.distinct(), "node").select(F.xxhash64("first").alias("h"), F.xxhash64("first", "node").alias("g")))
    log = min(BITMAP_LOG, max(20, chosen.count().bit_length() + 4))
    one, two = (spark.sparkContext.broadcast(bitmap_of(chosen.select(F.col(c).alias("h")), log)) for c in "hg")
    remove(spark, path)

    def run(batches):
        few, fewer = np.frombuffer(one.value, np.uint8), np.frombuffer(two.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(bits_of(few, log, batch.column(0).to_numpy().view(np.uint64))))
            ids, texts = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = Sets(texts[a:b])
                name = sets.names(seed)[0]
                # As Spark hashes a second column: by the hash of the first.
                g = [xxhash.xxh64_intdigest(x, int(h)) for x, h in zip(name.view("V8").tolist(), ids[a:b])]
                take = np.flatnonzero((sets.n > 0) & bits_of(fewer, log, np.array(g, np.uint64)))
                elements = pa.array([sets.of(k).tobytes() for k in take.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(name[take]), elements], ["node", "elements"])

    rows = docs.select(F.xxhash64(id_col).alias("h"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, "node long, elements binary")
    return rows.groupBy("node").agg(F.first("elements").alias("elements"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node of the edges.

    Each round a node takes the smallest label around it, then its label's label.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a)))
    both, both_path = written(both.distinct())
    labels, path = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("old"))
        beyond = labels.select(F.col("node").alias("start"), F.col("component").alias("at")).join(labels, F.col("at") == F.col("node"))
        beyond = beyond.select(F.col("start").alias("node"), "component", F.lit(None).cast("long").alias("old"))
        every = around.union(beyond).union(labels.select("node", "component", F.col("component").alias("old")))
        new, next_path = written(every.groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old")))
        remove(spark, path)
        labels, path = new.select("node", "component"), next_path
        if new.filter("component <> old").isEmpty():
            break
    remove(spark, both_path)
    release(spark)
    return labels


def kept_signatures(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, node without those signatures of each node that most nodes have, as far as its slack goes."""
    code = F.expr("shiftrightunsigned(slack, cast(16 * ((sig >> 2) & 3) as int)) & 65535")
    rows = found.join(nodes.select("node", "slack"), "node").withColumn("code", code)
    spare = F.when(F.col("code").bitwiseAND(3) == F.col("sig").bitwiseAND(3), F.shiftright("code", 2)).otherwise(0)
    place = F.row_number().over(W.partitionBy("node", F.col("sig").bitwiseAND(15)).orderBy(F.desc("m"), F.desc("sig")))
    return rows.select("sig", "node", spare.alias("spare"), place.alias("place")).filter("place > spare").select("sig", "node")


def buckets(kept: DataFrame) -> DataFrame:
    """sig, pivot, m of buckets with two nodes or more; of buckets with the same nodes one."""
    rows = kept.groupBy("sig").agg(F.min("node").alias("pivot"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return rows.filter("m > 1").groupBy("pivot", "m", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "pivot", "m")


def star_candidates(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: a bucket's pivot and each of its other nodes, if sizes and sketches let them be linked."""
    edges = live.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    for side in "ab":
        edges = edges.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    fits = (F.col("na") * 100 >= F.col("nb") * THRESHOLD) & (F.col("nb") * 100 >= F.col("na") * THRESHOLD)

    def prune(batches):
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            shapes: dict[tuple, list[int]] = {}
            for i, pair in enumerate(zip(x, y)):
                shapes.setdefault(tuple(map(len, pair)), []).append(i)
            apart = np.zeros(len(x), np.int64)
            for (p, q), at in shapes.items():
                u, v = (np.frombuffer(b"".join([z[i] for i in at]), np.uint64).reshape(len(at), -1) for z in (x, y))
                width = min(p, q) // 8
                apart[at] = np.bitwise_count(fold(u, width) ^ fold(v, width)).sum(axis=1, dtype=np.int64)
            ok = may_link(apart, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return edges.filter(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(prune, "a long, b long")


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges whose sets are linked."""
    for side in "ba":
        edges = edges.join(sets.select(F.col("node").alias(side), F.col("elements").alias(f"e{side}")), side)

    def verify(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return edges.select("a", "b", "ea", "eb").mapInArrow(verify, "a long, b long")


def pairs_within(label: np.ndarray, n: np.ndarray, sketch: list[bytes], block: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with unlike labels that sizes and sketches let be linked, those with the most similar sketches first.

    Across the two blocks, or within one if it is its ``own`` partner.
    """
    order = np.argsort(n, kind="stable")
    label, n, block = label[order], n[order], block[order]
    width = np.array([len(sketch[i]) // 8 for i in order.tolist()])
    rows = {int(w): np.frombuffer(b"".join(sketch[i] for i in order[width == w].tolist()), np.uint64).reshape(-1, w) for w in np.unique(width)}
    start = {w: int(np.searchsorted(width, w)) for w in rows}
    a, b, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    ends = np.searchsorted(n * THRESHOLD, n * 100, "right")
    folded: dict[tuple[int, int], np.ndarray] = {}
    for i in range(n.size):
        w = int(width[i])
        mine = rows[w][i - start[w]]
        for other, others in rows.items():
            lo, hi = max(i + 1, start[other]), min(int(ends[i]), start[other] + len(others))
            if other < w or lo >= hi:
                continue
            if (other, w) not in folded:
                folded[other, w] = fold(others, w)
            apart = np.bitwise_count(folded[other, w][lo - start[other] : hi - start[other]] ^ mine).sum(axis=1, dtype=np.int64)
            hit = (apart * (100 + THRESHOLD) <= (n[lo:hi] + n[i]) * (100 - THRESHOLD)) & (label[lo:hi] != label[i])
            if not own:
                hit &= block[lo:hi] != block[i]
            at = np.flatnonzero(hit)
            a.append(np.full(at.size, order[i]))
            b.append(order[lo + at])
            far.append(apart[at] / (n[lo + at] + n[i]))
    first = np.argsort(np.concatenate(far), kind="stable")
    return np.concatenate(a)[first], np.concatenate(b)[first]


def residual_tasks(live: DataFrame, labels: DataFrame, block_nodes: int) -> DataFrame:
    """task, own, block, node, label: nodes of buckets that aren't connected yet.

    A bucket is cut into blocks, and two blocks meet in one task.
    """
    rows = live.filter("m > 2").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    open_ = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("sig")
    rows = rows.join(open_, "sig").filter("node <> pivot")
    last = (F.col("m") / block_nodes).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), last + 1).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    task = F.xxhash64("sig", F.least("block", "with"), F.greatest("block", "with"))
    return rows.select(task.alias("task"), (F.col("block") == F.col("with")).alias("own"), "block", "node", "label")


def of_table(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return pairs_within(*(t[c].to_numpy() for c in ("label", "n")), t["sketch"].to_pylist(), t["block"].to_numpy(), t["own"][0].as_py())


def residual_wanted(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """task, node: the nodes of a task that sizes and sketches leave a partner."""

    def run(t: pa.Table) -> pa.Table:
        at = np.unique(np.concatenate(of_table(t)))
        return t.select(["task", "node"]).take(pa.array(at))

    return tasks.join(nodes.select("node", "n", "sketch"), "node").groupBy("task").applyInArrow(run, "task long, node long")


def residual_links(tasks: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that connect something new within their task, one fewer than its nodes at most."""

    def run(t: pa.Table) -> pa.Table:
        node, label, out = t["node"].to_numpy(), t["label"].to_numpy().copy(), []
        sets_ = [np.frombuffer(x, np.uint64) for x in t["elements"].to_pylist()]
        for x, y in zip(*(z.tolist() for z in of_table(t))):
            if label[x] != label[y] and linked(sets_[x], sets_[y]):
                out.append((int(node[x]), int(node[y])))
                label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = tasks.join(nodes.select("node", "n", "sketch"), "node").join(sets, "node")
    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    Texts are linked where their sets of distinct five-word shingles (A-Z in lower case;
    shorter texts are one shingle) have a Jaccard similarity of 0.8 or more;
    ``component_id`` is the smallest id that links lead to, the row's own included. Null
    texts and those without words have no shingle and are linked with nothing. Rows that
    repeat an id or a text are rows of one component; null ids sort after all others.
    """
    spark = docs.sparkSession
    count, size = total_bytes(docs, text_col)
    log = max(5, int(size * SIGNATURES_PER_BYTE / SHARD_SIGNATURES).bit_length(), (count // SHARD_ROWS).bit_length())
    for seed in range(8):  # other names for all if two sets share one, which hardly ever happens
        travelling = read_once(docs, id_col, text_col, log, seed)
        for step in range(2 * STEP_LOG, log + STEP_LOG, STEP_LOG):
            travelling = finer(travelling, min(step, log))
        first_rows, rows_path = written(shared(travelling))
        rows = first_rows.filter("sig is null").select("id", F.col("n").alias("n_shingles"), "node", "other", "sketch", "slack")
        nodes = rows.filter("node is not null").groupBy("node").agg(
            F.min("id").alias("first"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.max("slack").alias("slack"), F.min("other").alias("lo"), F.max("other").alias("hi")
        )
        nodes, nodes_path = written(nodes)
        release(spark)
        if nodes.filter("lo <> hi").isEmpty():
            break
        remove(spark, nodes_path)
        remove(spark, rows_path)
    kept, kept_path = written(kept_signatures(first_rows.filter("sig is not null").select("sig", "node", "m"), nodes))
    live, live_path = written(kept.join(buckets(kept), "sig"))
    remove(spark, kept_path)
    release(spark)

    stars, stars_path = written(star_candidates(live, nodes))
    release(spark)
    links, path = written(verified(*with_sets(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), docs, id_col, text_col, nodes, seed)))
    paths = [rows_path, nodes_path, live_path, stars_path, path]
    labels = components(links)
    first = stars.groupBy("b").agg(F.min("a").alias("a0"))
    others = stars.join(first, "b").filter("a <> a0").select("a", "b")
    more, path = written(unconnected(others, labels))
    release(spark)
    paths.append(path)
    if not more.isEmpty():
        new, path = written(verified(*with_sets(more, docs, id_col, text_col, nodes, seed)))
        paths.append(path)
        links = links.union(new)
        labels = components(links)
    tasks, path = written(residual_tasks(live, labels, block_nodes))
    wanted, wanted_path = written(residual_wanted(tasks, nodes))
    release(spark)
    paths += [path, wanted_path]
    if not wanted.isEmpty():
        sets = fetch_sets(docs, id_col, text_col, nodes, wanted.select("node"), seed)
        new, path = written(residual_links(tasks.join(wanted, ["task", "node"]), nodes, sets))
        paths.append(path)
        release(spark)
        labels = components(links.union(new))

    firsts = nodes.select("node", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = firsts.select("node", "component").join(ids, "component").select("node", "component_id")
    out = rows.select("id", "n_shingles", "node").join(by_node, "node", "left")
    out = out.select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out, _ = written(out)
    for path in paths:
        remove(spark, path)
    release(spark)
    return out


def unconnected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges whose ends have unlike labels."""
    for side in "ab":
        edges = edges.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    return edges.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def with_sets(edges: DataFrame, docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The edges and the sets of their nodes."""
    return edges, fetch_sets(docs, id_col, text_col, nodes, edges.select(F.col("a").alias("node")).union(edges.select("b")), seed)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest id.

    Texts without words stay. Of rows that share id and text one stays.
    """
    found = jaccard_components(docs, id_col, text_col)
    stay = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").isNull().alias("none"), F.xxhash64("id").alias("h"), F.col("id").alias("own")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).isNull().alias("none"), F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("version"))
    # One exchange serves both: rows dealt by (none, h) are also together by (none, h, id, text).
    rows = rows.join(stay, ["none", "h"]).filter(F.col(f"row.{id_col}").eqNullSafe(F.col("own")))
    return rows.dropDuplicates(["none", "h", "own", "version"]).select("row.*")
