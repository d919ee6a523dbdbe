"""Quality by nearest-neighbour voting in a latent-semantic space.

Fit: a bounded sample of labelled rows is turned into hashed term counts on the
executors, weighted by log tf and idf, and reduced by a randomised truncated SVD; words
and word shapes have a space each. The model, the two projections and the labelled
vectors, has a fixed largest size and is broadcast. Score: every document's cosine with
every labelled vector is computed in blocks, exactly, and its nearest neighbours' labels
are averaged with weights that grow with similarity.

The only inputs of a score are the text and the labels of the rows it was fitted on.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_PER_CLASS = 2000
#: Hash buckets of words and of shapes.
WORD_DIM, SHAPE_DIM = 4096, 1024
DIM = WORD_DIM + SHAPE_DIM
#: Latent dimensions of words and of shapes, and what the shape space weighs.
WORD_RANK, SHAPE_RANK = 48, 16
SHAPE_WEIGHT = 1.5
#: Neighbours that vote, and the power of the cosine that weights a vote.
NEIGHBOURS, POWER = 15, 8
#: Documents whose term counts are held at once.
ROWS = 192
MEMO_WORDS = 300_000

_CAPITALS = re.compile(rb"(?:[A-Z]|\xc3[\x80-\x9e]){2,}")
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_DIGITS = re.compile(rb"[0-9]+")
_REPEATS = re.compile(rb"(.)\1+", re.DOTALL)


def shape_of(word: bytes) -> bytes:
    """Case, digits and punctuation of a word, without its letters and lengths."""
    word = _LETTERS.sub(b"a", _CAPITALS.sub(b"\x01", word))
    return _REPEATS.sub(rb"\1\1", _DIGITS.sub(b"0", word))


class Terms(dict):
    """Memo word (bytes) -> hash bucket of the word and, shifted, of its shape."""

    def __missing__(self, word: bytes) -> int:
        w = xxhash.xxh3_64_intdigest(word.lower()) % WORD_DIM
        s = xxhash.xxh3_64_intdigest(shape_of(word)) % (SHAPE_DIM - 64)
        value = self[word] = w | (s + WORD_DIM) << 16
        return value

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Counts of the terms of each text, a row per text."""
        if len(self) > MEMO_WORDS:
            self.clear()
        out = np.zeros((len(texts), DIM), np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            if not words:
                continue
            t = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            out[i] = np.bincount(t & 0xFFFF, minlength=DIM) + np.bincount(t >> 16, minlength=DIM)
            # The last 64 shape buckets: how many neighbours are equal, how rich the words are.
            same = int(np.count_nonzero(t[1:] == t[:-1]))
            out[i, DIM - 32 + min(31, int(64 * same / t.size))] = 1 + t.size / 8
            out[i, DIM - 64 + min(31, int(32 * np.unique(t).size / t.size))] = 1 + t.size / 8
        return out


def sparse(row: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(row)
    return at.astype(np.uint16).tobytes(), row[at].astype(np.float32).tobytes()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def truncated_basis(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    return q.astype(np.float32)


class Model:
    """idf, the two projections and the labelled vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        if len(labels):
            df = np.count_nonzero(counts, axis=0)
            self.idf = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + 1
            x = self.weighted(counts)
            self.words = truncated_basis(x[:, :WORD_DIM], WORD_RANK)
            self.shapes = truncated_basis(x[:, WORD_DIM:], SHAPE_RANK)
            self.vectors = self.embed(counts)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x[:, :WORD_DIM] = unit(x[:, :WORD_DIM])
        x[:, WORD_DIM:] = unit(x[:, WORD_DIM:])
        return x

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = self.weighted(counts)
        return unit(np.hstack([unit(x[:, :WORD_DIM] @ self.words), SHAPE_WEIGHT * unit(x[:, WORD_DIM:] @ self.shapes)]))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The weighted mean label of the nearest neighbours; the labels' mean where none is near."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cos = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, at, axis=1), 0).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        vote = (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-12, vote, self.labels.mean()), 0, 1)


def sample_ids(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> list:
    """(id, label) of a bounded sample, as many of each class where there are, by hash order."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = one.agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    out = []
    for label in (0, 1):
        rows = one.filter(F.col("label") == label).orderBy(F.md5(F.col("id").cast("string")), "id").limit(per_class).collect()
        out += [(r["id"], r["label"]) for r in rows]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most ``per_class`` labelled rows of each class.

    Rows with a null id or label are passed over; several labels of one id are averaged.
    Without labelled rows the model gives every text 0.5.
    """
    spark = docs.sparkSession
    held = sample_ids(labels, id_col, label_col, per_class)
    if not held:
        return Model(np.zeros((0, DIM), np.float32), np.zeros(0))
    id_type = docs.schema[id_col].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame(held, f"id {id_type}, label int"))

    def run(batches):
        terms = Terms()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), ROWS):
                part = [sparse(r) for r in terms.counts(texts[i : i + ROWS])]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array([a for a, _ in part], pa.binary()), pa.array([b for _, b in part], pa.binary())], ["label", "at", "n"]
                )

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(docs, text_col).alias("t")).join(few, "id").select("label", "t")
    rows = rows.mapInArrow(run, "label int, at binary, n binary").collect()
    counts, y = np.zeros((len(rows), DIM), np.float32), np.zeros(len(rows))
    rows.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["n"])))
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
        y[i] = r["label"]
    return Model(counts, y)


def _scored(docs: DataFrame, model: Model, text_col: str, keep: dict) -> DataFrame:
    """The columns ``keep`` (name: column) and ``_score``."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    raw = docs.select(*[c.alias(k) for k, c in keep.items()], text_bytes(docs, text_col).alias("_bytes"))
    schema = raw.drop("_bytes").schema.add("_score", "double")
    names = [f.name for f in schema]

    def run(batches):
        fitted, terms = pickle.loads(held.value), Terms()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            s = [fitted.scores(terms.counts(texts[i : i + ROWS])) for i in range(0, len(texts), ROWS)]
            values = pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names)

    return raw.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row; null text counts as empty.

    Empty texts, and others that no labelled text is near, score the mean of the sampled labels.
    Of labelled texts with equal cosines at the last place, which ones vote is not defined.
    Scores of equal texts may differ by the rounding of float32 products (about 1e-7), as that
    depends on the batch. Other columns are not looked at.
    """
    return _scored(docs, model, text_col, {"id": F.col(id_col)}).withColumnRenamed("_score", "score")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns."""
    keep = {f"_c{i}": docs[c] for i, c in enumerate(docs.columns)}
    kept = _scored(docs, model, text_col, keep).filter(F.col("_score") >= threshold)
    return kept.select(*[F.col(k).alias(c) for k, c in zip(keep, docs.columns)])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, score`` of all ``docs``, learned from the rows of ``labels`` that aren't held out."""
    return score(docs, fit(docs, labels.filter(~held_out())))
