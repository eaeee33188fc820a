"""Vector expressions in double precision: dot product, L2 norm, cosine; float16 rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two double arrays of equal length; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """``v / max(|v|, 1e-12)`` as doubles; an all-zero vector stays all zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    pair = F.array(F.struct(as_double(v).alias("v"), length.alias("n")))
    return F.get(F.transform(pair, lambda p: F.transform(p.v, lambda x: x / p.n)), F.lit(0))


def distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def half_precision(v: Column) -> Column:
    """Values rounded to half precision, kept as ``array<float>`` (Spark has no half type)."""

    @F.pandas_udf("array<float>")
    def rounded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = s[s.notna()]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if len(there):
                # all values of the batch at once, cut where the vectors end
                flat = np.concatenate(there.to_numpy()).astype(np.float16).astype(np.float32)
                out[s.notna()] = np.array([*np.split(flat, np.cumsum(there.map(len).to_numpy())[:-1]), None], dtype=object)[:-1]
            yield out

    return rounded(v)


def mean_pool(tokens: Column, length: Column, skip: int = 1) -> Column:
    """Mean of the token vectors ``[skip, skip + length)`` of ``array<array<double>>``; null where there are none.

    Skips the prefix token, as the encoder puts one before the residues.
    """
    used = F.slice(tokens, skip + 1, F.greatest(length, F.lit(0)))
    total = F.aggregate(
        F.slice(used, 2, F.greatest(F.size(used) - 1, F.lit(0))), F.get(used, F.lit(0)), lambda s, t: F.zip_with(s, t, lambda a, b: a + b)
    )
    return F.when(F.size(used) > 0, F.transform(total, lambda x: x / F.size(used)))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of a series of equal-length arrays, normalized in double precision with the norm floor."""
    if not len(column):
        return np.empty((0, 0))
    m = np.array(column.tolist(), dtype=np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), NORM_FLOOR)
