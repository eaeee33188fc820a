"""Prefix filters over token sets: adaptive multi-match prefixes for self-joins.

A set is given by its rows (rep, token); ``need`` is the least number of tokens a
partner must share.  Tokens are ordered by how many sets hold them, rarest first.
If two sets share ``need`` tokens, then for every l up to ``need`` they share at
least l tokens among each one's first size - need + l.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE_COST, VERIFY_COST = 1.0, 4.0
#: Tokens whose counts are sent to all executors (16 bytes each); more are joined by shuffle.
BROADCAST_TOKENS = 2_000_000


def shared_tokens(exploded: DataFrame) -> DataFrame:
    """``token, n`` of the tokens that at least two sets hold.

    Counted map-side first, so a token in a third of all sets costs one row per
    partition.
    """
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def ordered_sets(exploded: DataFrame, counts: DataFrame) -> DataFrame:
    """``rep, shared``: each set's shared tokens as (n, token), rarest first; sets without any have no row.

    A set is bounded by its own tokens, whatever the size of the collection.  The
    written ``counts`` are counted before they are broadcast.
    """
    looked_up = F.broadcast(counts) if counts.count() <= BROADCAST_TOKENS else counts
    return (
        exploded.join(looked_up, "token").groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    )


def adaptive_prefixes(sets: DataFrame, need: int, most: int) -> DataFrame:
    """``rep, level, token``: the prefix of the level that is cheapest for each set of ``sets (rep, shared)``; further columns come along.

    Level l takes the first size - need + l tokens (those that no other set holds
    come first and cost nothing) and asks for l shared ones.  Its cost is one
    probe per entry in the lists of its tokens, plus one verification per
    expected candidate; at most entries / l sets can share l of them.  Sets with
    fewer than ``need`` shared tokens have no partner and give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shared")
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            token = flat.field("token").to_numpy()
            reached = np.r_[0.0, np.cumsum(flat.field("n").to_numpy() - 1.0)]
            start = np.cumsum(size) - size
            rows = np.flatnonzero(size >= need)
            start, size = start[rows], size[rows]
            cost, level, length = np.full(len(rows), np.inf), np.ones(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=np.int64)
            for l in range(1, min(need, most) + 1):
                entries = reached[start + size - need + l] - reached[start]
                now = entries * PROBE_COST + entries / l * VERIFY_COST
                better = now < cost
                cost, level, length = np.where(better, now, cost), np.where(better, l, level).astype(np.int32), np.where(better, size - need + l, length)
            within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            of_row = pa.array(np.repeat(rows, length))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(level, length)), pa.array(token[np.repeat(start, length) + within]), *(batch.column(c).take(of_row) for c in others)], names=["level", "token", *others]
            )

    others = [c for c in sets.columns if c != "shared"]
    return sets.mapInArrow(run, T.StructType([T.StructField("level", T.IntegerType()), T.StructField("token", T.LongType()), *(sets.schema[c] for c in others)]))
