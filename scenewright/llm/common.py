"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixers (fixed values, public domain finalisers).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Words known to one worker's hash memo before it is emptied: bounds its memory.
MEMO_WORDS = 1_000_000

#: Characters that count as white space everywhere in these operators.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder, set or configured.

    One of our own is made only on a local master, as in tests; a cluster without a
    shared folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="scenewright-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared checkpoint folder and read again, and its path.

    For loops: a checkpoint carries the size estimates of its plan along, which joins
    multiply in every round until the numbers themselves fill the driver; files have sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing refers to any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def salt(*cols: Column | str, salts: int) -> Column:
    """A salt in [0, salts) that spreads the rows of a hot key."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def with_salts(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """Each row once per salt, to meet the salted rows of the other side."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def total_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text).cast("long")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def text_bytes(docs: DataFrame, text: str) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(docs[text].cast("binary"), F.lit(b""))


class WordHashes(dict):
    """Memo word (bytes) -> 64-bit hash; emptied when it holds MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at ASCII white space.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at 0x20 and 0x09-0x0D only.
    """
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """A random 64-bit number for each byte that may stand in a word, A-Z as a-z; 0 for separators."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    out[65:91] = out[97:123]
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


#: Words cut at ASCII white space.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Bytes that are hashed at once: bounds a task's memory for a text of any length.
PIECE_BYTES = 1 << 20


def word_hashes(texts: list[bytes | None], table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and how many words each text has.

    A word's hash is the sum, over its bytes, of the byte's number times one for its place.
    No word is ever a Python object: the cost is a few array operations for each byte.
    """
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if not t:
            continue
        if len(t) > PIECE_BYTES:
            flush(texts, group, table, out, counts)
            group, size = [], 0
            first = 0
            while first < len(t):
                end = min(first + PIECE_BYTES, len(t))
                while end < len(t) and table[t[end]]:
                    end += 1
                h, n = few_hashes([t[first:end]], table)
                out.append(h)
                counts[k] += n[0]
                first = end
            continue
        group.append(k)
        size += len(t)
        if size >= PIECE_BYTES:
            flush(texts, group, table, out, counts)
            group, size = [], 0
    flush(texts, group, table, out, counts)
    return np.concatenate(out), counts


def flush(texts: list[bytes | None], group: list[int], table: np.ndarray, out: list[np.ndarray], counts: np.ndarray) -> None:
    if group:
        h, counts[group] = few_hashes([texts[k] for k in group], table)
        out.append(h)


def few_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    value = table[buffer]
    inside = value != 0
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    if buffer.size and inside[0]:
        starts = np.concatenate([[0], starts])
    edges = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, edges), prepend=0)
    if not starts.size:
        return np.zeros(0, np.uint64), counts
    lengths = np.diff(starts, append=buffer.size)
    place = np.arange(starts[0], buffer.size) - np.repeat(starts, lengths)
    weight = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * MIX_A) | np.uint64(1)
    return mix(np.add.reduceat(value[starts[0] :] * weight[place], starts - starts[0])), counts


def release(spark: SparkSession) -> None:
    """Lets go of plans, shuffle files, broadcasts and checkpoints that nothing refers to any more.

    Spark's cleaner follows the driver's garbage collector; a long chain of small jobs
    fills shared disk and the driver's memory long before that would run by itself.
    """
    gc.collect()
    spark._jvm.System.gc()
