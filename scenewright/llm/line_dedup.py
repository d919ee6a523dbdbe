"""Line dedup: repeated windows of three consecutive lines are kept once.

A line is what ends at a line feed or at the end of a sentence (``. ``, ``! ``, ``? ``),
so that passages count however they are wrapped. White space around lines and lines of
white space alone don't count. Every window of three consecutive lines is hashed; windows
that occur twice or more anywhere are found globally; the first occurrence, by id and
place, stays. In each document the places covered by later occurrences are merged and
removed. No line's text is lost: a removed line stands in an earlier occurrence, and
following it from there always leads to an earlier place, at last to one that stays.

Only fixed-width rows (id, place, 128 bits of hash) are shuffled to find repeats; the text
travels once, to meet its document's places. A window may be in a third of all documents:
occurrences are summed before the exchange, and windows that hold more than a
HOT_SHARE-th of all repeated ones, of which there are fewer than HOT_SHARE, are salted in
the join back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import GOLDEN, mix, release, remove, salt, with_salts, written

#: Lines in a window, and the characters that a window has at least where nothing else is asked for.
WINDOW, MIN_CHARS = 3, 0
#: A window is hot if it has more than one in so many of all repeated windows; and the salts of a hot one.
HOT_SHARE, SALTS = 1000, 64
#: White space around lines that doesn't count.
SPACE = " \t\n\x0b\x0c\r"
#: Where a line ends.
LINE_END = re.compile(r"(?<=\n)|(?<=[.!?] )")


def parts_of(text: str | None) -> list[str]:
    """The parts of a text, which joined give the text; a part is a line or white space."""
    if not text:
        return []
    if "\0" in text:
        return LINE_END.split(text)
    for end in ("\n", ". ", "! ", "? "):
        text = text.replace(end, end + "\0")
    return text.split("\0")


def windows(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, version, place, hash, more of every window of ``min_chars`` characters at least.

    ``version`` is a hash of the text: rows that share an id but not a text keep apart.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            hashes, lengths, counts = [], [], []
            for text in batch.column(2).to_pylist():
                lines = [x for x in (p.strip(SPACE) for p in parts_of(text)) if x]
                counts.append(len(lines))
                hashes += map(xxhash.xxh3_128_digest, lines)
                lengths += map(len, lines)
            n, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
            h = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
            doc = np.repeat(np.arange(counts.size), counts)
            place = np.arange(n.size) - np.repeat(np.cumsum(counts) - counts, counts)
            last = WINDOW - 1
            at = np.flatnonzero((doc[last:] == doc[: n.size - last]) & (n[:-2] + n[1:-1] + n[2:] >= min_chars)) if n.size > last else np.zeros(0, np.int64)
            # Two hashes of the lines' 128-bit ones: their first and their second halves.
            both = [np.zeros(at.size, np.uint64), np.zeros(at.size, np.uint64)]
            for k in range(WINDOW):
                both = [mix(w * GOLDEN + x[at + k]) for w, x in zip(both, h.T)]
            take = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(place[at], pa.int32()), *[pa.array(w.view(np.int64)) for w in both]], ["id", "version", "place", "hash", "more"]
            )

    return raw.mapInArrow(run, raw.drop("text").schema.add("place", "integer").add("hash", "long").add("more", "long"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id, version, later: places of windows that stand at an earlier place, too."""
    rows = windows(docs, id_col, text_col, min_chars)
    order = F.struct(F.col("id").isNull().alias("z"), "id", "version", "place")
    found = rows.groupBy("hash", "more").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    found, path = written(found)
    every = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > every
    cold_or_salted = found.filter(~hot).withColumn("_salt", F.lit(0)).union(with_salts(found.filter(hot), SALTS)).drop("n")
    few = F.broadcast(found.filter(hot).select("hash", "more", F.lit(True).alias("hot")))
    rows = rows.join(few, ["hash", "more"], "left").withColumn("_salt", F.when(F.col("hot"), salt("id", "place", salts=SALTS)).otherwise(0)).drop("hot")
    rows = rows.join(cold_or_salted, ["hash", "more", "_salt"]).filter(~order.eqNullSafe(F.col("first")))
    hit, _ = written(rows.groupBy("id", "version").agg(F.collect_set("place").alias("later")))
    release(docs.sparkSession)
    remove(docs.sparkSession, path)
    return hit


def covered(places: Column) -> Column:
    """All line numbers of the windows at these places."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (WINDOW - 1)))))


def cleaned(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (the input's columns as a struct), clean, n_lines, removed_lines."""
    hit = repeats(docs, id_col, text_col, min_chars)
    hit = hit.select("id", "version", F.array_sort(covered(F.col("later"))).alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_version"))
    rows = rows.join(hit, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_version") == F.col("version")), "left")
    rows = rows.select("row", F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts, clean, counts = batch.column(0).field(place).to_pylist(), [], []
            for text, gone in zip(texts, batch.column(1).to_pylist()):
                parts = parts_of(text)
                lines = [i for i, p in enumerate(parts) if p.strip(SPACE)]
                counts.append(len(lines))
                if gone:
                    out = {lines[k] for k in gone}
                    text = "".join(p for i, p in enumerate(parts) if i not in out)
                clean.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.string()), pa.array(counts, pa.int32())], ["row", "removed_lines", "clean", "n_lines"])

    return rows.mapInArrow(run, StructType(list(rows.schema)).add("clean", "string").add("n_lines", "integer"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, text`` (cleaned), ``n_lines, removed_lines`` of every row.

    ``removed_lines`` are the sorted numbers, from 0, of the lines taken out. Null text
    stays null and has no lines; a text of fewer than three lines is never changed.
    Rows that repeat an id with the same text are one document and get the same result.
    A null id sorts after all others, rows that share an id but not a text by a hash of the
    text. Other columns are ignored. Windows under ``min_chars`` characters don't count; by
    default every window does.
    """
    return cleaned(docs, id_col, text_col, min_chars).select(F.col(f"row.{id_col}").alias("id"), F.col("clean").alias("text"), "n_lines", "removed_lines")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with clean texts; those that lose every line go.

    ``length_col``, if given and there, is the number of characters and is made anew for
    texts that change. All other columns pass through.
    """
    out = cleaned(docs, id_col, text_col, min_chars)
    changed = F.size("removed_lines") > 0
    out = out.filter(~changed | (F.size("removed_lines") < F.col("n_lines")))

    def column(c: str):
        if c == text_col:
            return F.col("clean").alias(c)
        if c == length_col:
            return F.when(changed, F.char_length("clean").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.{c}")).alias(c)
        return F.col(f"row.{c}").alias(c)

    return out.select(*[column(c) for c in docs.columns])
