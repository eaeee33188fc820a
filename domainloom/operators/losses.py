"""Contrastive losses of labelled batches as relational queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import matrix


def supcon_loss(samples: DataFrame, temperature: float = 0.07, normalize: bool = False) -> DataFrame:
    """``batch, anchors, loss`` of ``samples (batch, item, vec, label)``: supervised contrastive loss per batch.

    Every item is compared with the others of its batch, which the caller bounds,
    as one matrix product; 0.0 for a batch in which no label occurs twice.
    """
    kind = samples.schema["batch"].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf["vec"]) if normalize else np.array(pdf["vec"].tolist(), dtype=np.float64)
        codes = pd.factorize(pdf["label"])[0]
        s = v @ v.T / temperature
        s -= s.max(axis=1, keepdims=True)
        off = ~np.eye(len(v), dtype=bool)
        positive = (codes[:, None] == codes[None, :]) & (codes >= 0)[:, None] & off
        n = positive.sum(axis=1)
        z = np.log(np.maximum(np.where(off, np.exp(s), 0.0).sum(axis=1), 1e-12))
        valid = n > 0
        each = np.where(positive, s, 0.0).sum(axis=1)[valid] / n[valid] - z[valid]
        return pd.DataFrame({"batch": [key[0]], "anchors": [int(valid.sum())], "loss": [float(-each.mean()) if len(each) else 0.0]})

    rows = samples.select("batch", F.col("vec").cast("array<double>").alias("vec"), "label")
    return rows.groupBy("batch").applyInPandas(one, f"batch {kind}, anchors bigint, loss double")


def proxy_anchor_loss(samples: DataFrame, proxies: DataFrame, margin: float = 0.1, alpha: float = 32.0, most_proxies: int = 100_000) -> DataFrame:
    """``batch, present, loss`` of ``samples (batch, vec, label)`` against ``proxies (label, vec)``, both normalized here.

    Positives count over the classes a batch holds, negatives over all classes.
    The proxies go to the executors in blocks of about ``most_proxies``; a class's
    sums need its own proxy only, so the blocks' results add up.  A batch, which
    the caller bounds, is one matrix product per block.
    """
    total = proxies.count()
    blocks = max(1, -(-total // most_proxies))
    kind = samples.schema["batch"].dataType.simpleString()
    rows = samples.select("batch", F.col("vec").cast("array<double>").alias("vec"), "label")

    def against(labels: np.ndarray, p: np.ndarray) -> DataFrame:
        classes = samples.sparkSession.sparkContext.broadcast((labels, p))

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            labels, p = classes.value
            if not len(labels):
                return pd.DataFrame({"batch": [key[0]], "present": [0], "pos": [0.0], "neg": [0.0]})
            cos = matrix(pdf["vec"]) @ p.T
            own = pdf["label"].to_numpy()[:, None] == labels[None, :]
            pos = np.where(own, np.exp(-alpha * (cos - margin)), 0).sum(axis=0)
            neg = np.where(own, 0, np.exp(alpha * (cos + margin))).sum(axis=0)
            present = own.any(axis=0)
            return pd.DataFrame({"batch": [key[0]], "present": [int(present.sum())], "pos": [float(np.log1p(pos[present]).sum())], "neg": [float(np.log1p(neg).sum())]})

        return rows.groupBy("batch").applyInPandas(one, f"batch {kind}, present bigint, pos double, neg double")

    parts = None
    for b in range(blocks):
        mine = proxies.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b)
        local = mine.select("label", F.col("vec").cast("array<double>").alias("vec")).orderBy("label").toPandas()
        part = against(local["label"].to_numpy(), matrix(local["vec"]))
        parts = part if parts is None else parts.union(part)
    present = F.sum("present")
    return parts.groupBy("batch").agg(
        present.alias("present"), (F.sum("pos") / F.greatest(present, F.lit(1)) + F.sum("neg") / F.lit(max(total, 1))).alias("loss")
    )


def learning_rates(spark: SparkSession, epochs: int, base: float, warmup: int = 10, least: float = 1e-6) -> DataFrame:
    """``epoch, learning_rate``: linear from 0.01 x base over the warm-up, then cosine to ``least``."""
    e = F.col("epoch").cast("double")
    warm = base * (0.01 + 0.99 * e / max(warmup, 1))
    cosine = least + (base - least) * (1 + F.cos(math.pi * (e - warmup) / max(epochs - warmup, 1))) / 2
    return spark.range(epochs).select(F.col("id").alias("epoch")).withColumn("learning_rate", F.when(F.col("epoch") < warmup, warm).otherwise(cosine))
