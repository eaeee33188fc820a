"""Sequences to vectors: tokenizable form, length-sorted batches, pluggable encoders, stores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import number_rows


@dataclass(frozen=True)
class EncodeConfig:
    """Limits of an encoder batch and the type that vectors are stored in (fixed values)."""

    max_residues: int = 4000
    max_batch: int = 100
    max_seq_len: int = 1000
    dtype: str = "float16"


class Encoder(Protocol):
    """One model per Python worker: ``encode`` gives vectors by id and may leave out those it fails on."""

    dim: int

    def encode(self, sequences: Mapping[str, str]) -> dict[str, np.ndarray]: ...


class KmerEncoder:
    """A deterministic stand-in for a language model: signed counts of hashed k-mers, of unit length."""

    def __init__(self, dim: int = 64, k: int = 3) -> None:
        self.dim, self.k = dim, k

    def encode(self, sequences: Mapping[str, str]) -> dict[str, np.ndarray]:
        out = {}
        for name, seq in sequences.items():
            if not seq:
                continue
            v = np.zeros(self.dim)
            for i in range(max(len(seq) - self.k + 1, 1)):
                h = int.from_bytes(hashlib.blake2b(seq[i : i + self.k].encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            out[name] = (v / max(float(np.sqrt(v @ v)), 1e-12)).astype(np.float32)
        return out


RESIDUES = "ACDEFGHIKLMNPQRSTVWXY"


class CompositionEncoder:
    """The share of each of ``RESIDUES`` in a sequence."""

    dim = len(RESIDUES)

    def encode(self, sequences: Mapping[str, str]) -> dict[str, np.ndarray]:
        return {name: np.array([seq.count(r) for r in RESIDUES], dtype=np.float32) / len(seq) for name, seq in sequences.items() if seq}


class RefusingEncoder(CompositionEncoder):
    """Raises on every batch that holds a length which ``divisor`` divides: a stand-in for a model that fails on some batches."""

    def __init__(self, divisor: int) -> None:
        self.divisor = divisor

    def encode(self, sequences: Mapping[str, str]) -> dict[str, np.ndarray]:
        if any(len(s) % self.divisor == 0 for s in sequences.values()):
            raise ValueError(f"a length that {self.divisor} divides")
        return super().encode(sequences)


def masked(sequence: Column) -> Column:
    """U, Z and O replaced by X."""
    return F.translate(sequence, "UZO", "XXX")


def tokenizable(sequence: Column, prefix: str = "<AA2fold>") -> Column:
    """Prefix, then the masked residues separated by spaces; the prefix alone for an empty sequence."""
    residues = F.filter(F.split(masked(sequence), ""), lambda x: x != "")
    return F.concat_ws(" ", F.lit(prefix), F.array_join(residues, " ")) if prefix else F.array_join(residues, " ")


def batches_of(lengths: list[int], max_residues: int, max_batch: int, max_seq_len: int) -> list[int]:
    """Batch number of each length: a batch closes after the item with which it holds ``max_batch`` items, at least ``max_residues``, or one longer than ``max_seq_len``."""
    out, batch, items, total = [], 0, 0, 0
    for n in lengths:
        out.append(batch)
        items, total = items + 1, total + n
        if items >= max_batch or total >= max_residues or n > max_seq_len:
            batch, items, total = batch + 1, 0, 0
    return out


def batch_runs(counts: list[tuple[int, int]], config: EncodeConfig) -> list[tuple[int, int, int, int]]:
    """``(length, batch, head, each)`` of ``(length, items)`` pairs, longest first: the same batches as ``batches_of``, by runs.

    Of the items of one length the first ``head`` go to ``batch`` and every
    ``each`` after them to the next one.
    """
    out, batch, items, total = [], 0, 0, 0
    for length, n in counts:
        if length > config.max_seq_len:
            head = each = 1
        else:
            fits = -(-(config.max_residues - total) // length) if length else n + config.max_batch
            head = max(1, min(config.max_batch - items, fits))
            each = max(1, min(config.max_batch, -(-config.max_residues // length) if length else config.max_batch))
        out.append((length, batch, head, each))
        if n < head:
            items, total = items + n, total + n * length
        else:
            full, items = divmod(n - head, each)
            batch, total = batch + 1 + full, items * length
    return out


def encoder_batches(sequences: DataFrame, config: EncodeConfig = EncodeConfig(), group: str = "file") -> DataFrame:
    """``sequences`` with ``batch`` per ``group``: longest first, ties by position, closed as ``batches_of`` says.

    Only how many sequences a group has of each length decides where its batches
    close, so the fold runs over that table, and the sequences themselves are
    numbered range by range and look their batch up: a file of any size is no
    single task.
    """
    counts = sequences.groupBy(group, "length").agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType([T.StructField("_g", sequences.schema[group].dataType), *T._parse_datatype_string("_l int, _batch bigint, _head bigint, _each bigint").fields])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length", ascending=False)
        runs = batch_runs([(int(x), int(n)) for x, n in zip(pdf["length"], pdf["n"])], config)
        out = pd.DataFrame(runs, columns=["_l", "_batch", "_head", "_each"])
        out.insert(0, "_g", pdf[group].iloc[0])
        return out

    runs = counts.groupBy(group).applyInPandas(fold, schema)
    parts = max(1, int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(group), F.col("length").desc(), F.col("pos")]
    ordered = sequences.drop("batch").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = number_rows(ordered.withColumn("_run", F.concat_ws("\u0001", F.col(group).cast("string"), F.col("length").cast("string"))), "_run", "_n")
    batch = F.when(F.col("_n") < F.col("_head"), F.col("_batch")).otherwise(F.col("_batch") + 1 + F.floor((F.col("_n") - F.col("_head")) / F.col("_each")))
    joined = numbered.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("length") == F.col("_l")))
    return joined.withColumn("batch", batch.cast("int")).drop("_run", "_n", "_g", "_l", "_batch", "_head", "_each")


def encode_all(sequences: DataFrame, make_encoder: Callable[[], Encoder], config: EncodeConfig = EncodeConfig()) -> DataFrame:
    """``file, pos, id, embedding, failure`` of ``sequences (file, pos, id, sequence, length)``: a vector, or why there is none.

    Sequences are encoded in the batches of ``encoder_batches``, longest first over
    each file, so which ids share a batch does not depend on partitions.  A batch
    that raises fails as a whole and the next one goes on; ids that the encoder
    leaves out and empty sequences fail alone.
    """
    filled = F.length("sequence") > 0
    prepared = sequences.where(filled).select("file", "pos", "id", masked(F.col("sequence")).alias("sequence"), F.col("length").cast("int").alias("length"))
    ordered = encoder_batches(prepared, config).repartition("file", "batch").sortWithinPartitions("file", "batch", F.desc("length"), "pos")

    def whole_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of one encoder batch at a time, put together again where Arrow cut them."""
        held: pd.DataFrame | None = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            begins = (pdf["batch"].ne(pdf["batch"].shift()) | pdf["file"].ne(pdf["file"].shift())).to_numpy(copy=True)
            if len(pdf):
                cuts = [*np.flatnonzero(begins), len(pdf)]
                for lo, hi in zip(cuts[:-2], cuts[1:-1]):
                    yield pdf.iloc[lo:hi]
                held = pdf.iloc[cuts[-2] :]
        if held is not None and len(held):
            yield held

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for part in whole_batches(frames):
            found, why = {}, "left out by the encoder"
            try:
                found = encoder.encode(dict(zip(part["id"], part["sequence"])))
            except Exception as e:  # noqa: BLE001 - whatever the plug-in raises fails its batch only
                why = f"{type(e).__name__}: {e}"
            vectors = [np.asarray(found[i], dtype=np.float32).astype(config.dtype).astype(np.float32) if i in found else None for i in part["id"]]
            yield pd.DataFrame({"file": part["file"].array, "pos": part["pos"].array, "id": part["id"].array, "embedding": vectors, "failure": [None if v is not None else why for v in vectors]})

    kinds = "file string, pos bigint, id string, embedding array<float>, failure string"
    made = ordered.select("file", "pos", "id", "sequence", "batch").mapInPandas(run, kinds)
    empty = sequences.where(~F.coalesce(filled, F.lit(False))).select("file", "pos", "id", F.lit(None).cast("array<float>").alias("embedding"), F.lit("empty sequence").alias("failure"))
    return made.union(empty)


def encode(sequences: DataFrame, make_encoder: Callable[[], Encoder], config: EncodeConfig = EncodeConfig()) -> DataFrame:
    """``file, pos, id, embedding`` of the sequences that ``encode_all`` finds a vector for."""
    return encode_all(sequences, make_encoder, config).where(F.col("embedding").isNotNull()).drop("failure")


def with_labels(encoded: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labelled rows, ids without a label)``; raises where no row has one."""
    known = encoded.join(labels.select("id", "label"), "id")
    missing = encoded.join(labels.select("id"), "id", "left_anti").select("id")
    if known.isEmpty():
        raise ValueError("no encoded sequence has a label")
    return known, missing


def as_store(encoded: DataFrame) -> DataFrame:
    """``row_id, id, embedding`` with row ids in (file, pos) order, dense from 0.

    Numbered range by range, so no task holds all rows.
    """
    parts = max(1, int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionByRange(parts, "file", "pos").sortWithinPartitions("file", "pos").withColumn("_all", F.lit(0))
    return number_rows(ordered, "_all", "row_id").select("row_id", *[c for c in encoded.columns if c not in ("file", "pos", "row_id")])


def residue_totals(sequences: DataFrame, by: str = "file") -> DataFrame:
    """``by, sequences, residues``."""
    return sequences.groupBy(by).agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").cast("bigint").alias("residues"))
