"""String and vector similarity: Indel ratios as Arrow functions, cosine as an expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit per character of ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 where equal; 100 * 2 * LCS / (length of both) else. Two empty strings are equal."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs_length(a, b) / n


def best_window_ratio(needle: str, text: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows at the ends being shorter."""
    a, b = sorted((needle, text), key=len)
    if not a:
        return 100.0 if not b else 0.0
    best, n, letters = 0.0, len(a), set(a)
    for end in range(1, len(b) + n):
        w = b[max(0, end - n) : end]
        if w[-1] in letters or w[0] in letters:
            best = max(best, indel_ratio(a, w))
            if best == 100.0:
                break
    return best


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    order = lambda s: " ".join(sorted((s or "").split()))
    return pd.Series([indel_ratio(order(x), order(y)) for x, y in zip(a, b)], dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 1e-9 keeps zero vectors from dividing by zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))
