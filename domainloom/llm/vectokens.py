"""Token sets of vectors, for joins by shared tokens.

A vector becomes ``tables`` tokens.  A token of table t joins ``depth`` codes; each
code is the axis (and its sign) on which a random rotation of the unit vector is
largest.  Two vectors at cosine c get the same code with a probability that
depends on c only, so near vectors share many tokens and others almost none.

The plan (depth, tables, least overlap) follows from the row count, the threshold
and the accepted chance of missing a pair that lies right at the threshold:
``depth`` grows with the logarithm of the row count so that the far tokens met per
row stay bounded; ``tables`` is the least number for which a pair at the threshold
shares fewer than ``overlap`` tokens with a chance of at most ``miss``.  Pairs
above the threshold share more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64
SEED = 20240607


@dataclass(frozen=True)
class TokenPlan:
    """How vectors become tokens; ``agree`` is the chance that one code agrees at the threshold."""

    threshold: float
    depth: int
    tables: int
    overlap: int
    agree: float
    sketch_bits: int = 128

    @property
    def sketch_limit(self) -> int:
        """Differing sketch bits beyond which a pair is below the threshold, with a chance under 1e-7 of being wrong."""
        p = math.acos(self.threshold) / math.pi
        k, tail = 0, 1.0
        while tail > 1e-7:
            tail -= math.comb(self.sketch_bits, k) * p**k * (1 - p) ** (self.sketch_bits - k)
            k += 1
        return k


def agreement(threshold: float, dim: int = DIM, samples: int = 200_000) -> float:
    """Chance that two vectors at cosine ``threshold`` get the same code, measured on random pairs of a fixed seed."""
    rng = np.random.default_rng(SEED)
    # in a rotated frame a random pair is a standard normal vector and a mix of it with another
    a = rng.standard_normal((samples, dim), dtype=np.float32)
    b = threshold * a + math.sqrt(1 - threshold**2) * rng.standard_normal((samples, dim), dtype=np.float32)
    ia, ib = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1)
    at = np.arange(samples)
    return float(((ia == ib) & (np.sign(a[at, ia]) == np.sign(b[at, ib]))).mean())


def token_plan(rows: int, threshold: float, overlap: int = 3, miss: float = 1e-5, dim: int = DIM) -> TokenPlan:
    """The plan for a collection of ``rows`` vectors."""
    agree = agreement(threshold, dim)
    depth = max(3, math.ceil(math.log(max(rows, 2)) / math.log(2.5 * dim)))
    p, tables = agree**depth, overlap
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(overlap)) > miss:
        tables += 1
    return TokenPlan(threshold, depth, tables, overlap, agree)


def usable(v: Column, dim: int = DIM) -> Column:
    """Whether a vector has ``dim`` values, none of them null or NaN, not all zero."""
    return F.coalesce(
        (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def matrix(vectors: pd.Series, dim: int = DIM) -> np.ndarray:
    """Unit rows in double precision of a series of arrays."""
    return unit_rows(np.concatenate(vectors.to_numpy()) if len(vectors) else np.empty(0), dim)


def unit_rows(values: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Unit rows in double precision of ``dim`` values each, laid end to end."""
    m = values.astype(np.float64).reshape(-1, dim)
    scale = np.abs(m).max(axis=1, keepdims=True)  # keeps squares of very large or small values finite
    m = m / np.where(scale == 0, 1, scale)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Tokenizer:
    """Applies a plan; rotations follow from the seed, so every worker builds the same ones."""

    def __init__(self, plan: TokenPlan, dim: int = DIM, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.plan, self.dim = plan, dim
        n = plan.depth * plan.tables
        turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)]
        self.rotations = np.concatenate(turns, axis=1).astype(np.float32)
        self.planes = rng.standard_normal((dim, plan.sketch_bits)).astype(np.float32)

    def tokens(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) signed 64-bit tokens; tokens of different tables never mean the same."""
        out = np.empty((len(unit), self.plan.tables), dtype=np.uint64)
        x = unit.astype(np.float32)
        width = self.dim * self.plan.depth
        for t in range(self.plan.tables):
            y = (x @ self.rotations[:, t * width : (t + 1) * width]).reshape(len(x) * self.plan.depth, self.dim)
            axis = np.abs(y).argmax(axis=1)
            code = (axis * 2 + (y[np.arange(len(y)), axis] > 0)).reshape(len(x), self.plan.depth).astype(np.uint64)
            h = np.full(len(x), t + 1, dtype=np.uint64)
            for k in range(self.plan.depth):
                h = h * np.uint64(2 * self.dim + 1) + code[:, k]
            out[:, t] = _mix(h)
        return out.view(np.int64)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """(rows, 2) 64-bit words of signs against random planes."""
        bits = np.packbits((unit.astype(np.float32) @ self.planes) > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.int64)


def copy_key(unit: np.ndarray, exact: bool = False) -> list[bytes]:
    """A key that vectors of the same direction share.

    Components are rounded to 2^-14: different vectors closer than that may share a
    key too, which only a threshold far beyond it allows.  With ``exact`` none do; a
    multiple whose stored values were rounded is then a vector of its own.
    """
    q = np.ascontiguousarray(unit + 0.0 if exact else np.round(unit * 2**14).astype(np.int16))
    width, whole = max(1, q.shape[1] * q.itemsize), memoryview(q).cast("B") if q.size else b""
    return [hashlib.blake2b(whole[i : i + width], digest_size=16).digest() for i in range(0, len(q) * width, width)]


def usable_rows(vectors: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """``(places, values)`` of the usable vectors among Arrow lists, as ``usable`` says: their rows, and their values laid end to end."""
    places = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy() == dim)
    values = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null value becomes NaN
    good = ~np.isnan(values).any(axis=1) & (values != 0).any(axis=1)
    return places[good], values[good].ravel()


def with_copy_key(vectors: DataFrame, id_col: str, vec_col: str, *keep: str, dim: int = DIM, exact: bool = False) -> DataFrame:
    """``id_col, *keep, copy binary, vec array<float>`` of the usable vectors with an id; ``vec`` holds the stored values, ``exact`` is as in ``copy_key``."""
    base = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(id_col, *keep, F.col(vec_col).cast("array<float>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = usable_rows(batch.column("vec"), dim)
            kept = batch.take(pa.array(places))
            copy = pa.array(copy_key(unit_rows(values, dim), exact), pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns, copy], names=[*kept.schema.names, "copy"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("copy", T.BinaryType())]))


def token_sets(representatives: DataFrame, plan: TokenPlan, *keep: str, dim: int = DIM) -> DataFrame:
    """``rep, *keep, tokens array<bigint>, s0, s1`` of ``representatives (rep, *keep, vec)``."""
    kinds = "".join(f"{c} {representatives.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(plan, dim)
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                part = pdf.iloc[i : i + 2048]
                unit = matrix(part["vec"], dim)
                out = part[["rep", *keep]].copy()
                out["tokens"] = list(tokenizer.tokens(unit))
                s = tokenizer.sketch(unit)
                out["s0"], out["s1"] = s[:, 0], s[:, 1]
                yield out

    return representatives.select("rep", *keep, "vec").mapInPandas(run, f"rep bigint, {kinds}tokens array<bigint>, s0 bigint, s1 bigint")


def sketch_close(a: str, b: str, limit: int) -> Column:
    """Whether the sketches of the sides ``a`` and ``b`` differ in at most ``limit`` bits."""
    differ = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")))
    return differ <= limit


def verified(pairs: DataFrame, a: str, b: str, left: DataFrame, right: DataFrame, threshold: float, dim: int = DIM, plan: TokenPlan | None = None) -> DataFrame:
    """``pairs`` with their exact ``cosine``, where it reaches ``threshold``; ``left`` and ``right`` give ``rep, vec``.

    The pairs are those that shared enough tokens and whose sketches are close,
    so nearly all of them are true; the vectors reach them by two joins on the id.
    With ``plan``, the whole token sets of a pair must also overlap as it asks.
    """
    both = pairs.join(left.select(F.col("rep").alias(a), F.col("vec").alias("_va")), a).join(
        right.select(F.col("rep").alias(b), F.col("vec").alias("_vb")), b
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    names = pairs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(plan, dim) if plan is not None else None
        for pdf in batches:
            va, vb = matrix(pdf["_va"], dim), matrix(pdf["_vb"], dim)
            cosine = np.einsum("ij,ij->i", va, vb)
            near = cosine >= threshold
            if tokenizer is not None:
                common = (tokenizer.tokens(va[near]) == tokenizer.tokens(vb[near])).sum(axis=1)
                near[near] = common >= plan.overlap
            out = pdf.loc[near, names].copy()
            out["cosine"] = cosine[near]
            yield out

    return both.mapInPandas(run, f"{kinds}, cosine double")
