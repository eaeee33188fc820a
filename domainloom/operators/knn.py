"""Exact cosine k-nearest-neighbour join.

Input: ``queries (query_pos, vec)`` and ``index (row_id, vec)``; output:
``query_pos, rank, db_row, similarity, distance``.  Similarities are compared
after rounding to ten decimals, so equal vectors tie on every path, and ties go to
the smaller ``row_id``.

* ``expression``: a nested-loop join with native expressions, for small tables.
* ``block``: the index is broadcast as one matrix, queries stream by in batches
  and no row is shuffled.  Only for an index of at most ``BROADCAST_BYTES``.
* ``two_phase``: for larger ones. Queries and index are cut into a grid of blocks of
  bounded bytes and every query block meets every index block as one matrix
  product; the k best of each are merged by a second top-k.  The grid is as coarse
  as bytes and parallelism allow, so a row is copied about as often as the square
  root of the number of tasks.
* ``auto`` counts the index and takes ``block`` or ``two_phase``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import as_double, dot, l2_normalize, matrix

BROADCAST_BYTES = 256 * 2**20
#: Bytes of one side that a task of ``two_phase`` holds.
TASK_BYTES = 128 * 2**20
#: Similarities computed at once by a worker (several copies of 8 bytes each are held).
STEP = 2**22
SCHEMA = "query_pos bigint, rank int, db_row bigint, similarity double, distance double"
DIGITS = 10


def _top(similarity: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, index places and similarities of the k best per query; ``rows`` ascend, so a stable order breaks ties by row."""
    s = np.round(similarity, DIGITS)
    if own is not None:
        s[own[:, None] == rows[None, :]] = -np.inf
    take = min(k + (own is not None), s.shape[1])
    if take and take < s.shape[1]:
        # everything at least as similar as the k-th best, then in exact order
        bound = -np.partition(-s, take - 1, axis=1)[:, take - 1]
        q, i = np.nonzero(s >= bound[:, None])
    else:
        q, i = np.nonzero(s > -np.inf)
    v = s[q, i]
    order = np.lexsort((rows[i], -v, q))
    q, i, v = q[order], i[order], v[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, dtype=bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.empty(0, dtype=int)
    keep = (rank < k) & (v > -np.inf)
    return q[keep], i[keep], v[keep]


def _frame(pos: np.ndarray, db: np.ndarray, similarity: np.ndarray) -> pd.DataFrame:
    first = np.r_[True, pos[1:] != pos[:-1]] if len(pos) else np.empty(0, dtype=bool)
    at = np.arange(len(pos))
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) + 1 if len(pos) else at
    return pd.DataFrame({"query_pos": pos, "rank": rank.astype(np.int32), "db_row": db, "similarity": similarity, "distance": 1.0 - similarity})


def _expression(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    q = queries.select("query_pos", l2_normalize(F.col("vec")).alias("_q"))
    d = index.select(F.col("row_id").alias("db_row"), l2_normalize(F.col("vec")).alias("_d"))
    on = F.col("query_pos") != F.col("db_row") if exclude_self else F.lit(True)
    pairs = q.join(d, on).select("query_pos", "db_row", F.round(dot(F.col("_q"), F.col("_d")), DIGITS).alias("similarity"))
    best = Window.partitionBy("query_pos").orderBy(F.desc("similarity"), "db_row")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_pos", "rank", "db_row", "similarity", (1.0 - F.col("similarity")).alias("distance"))


def _block(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    # bounded by BROADCAST_BYTES: ``knn_join`` counts the index before it comes here
    local = index.select("row_id", as_double(F.col("vec")).alias("vec")).orderBy("row_id").toPandas()
    shared = index.sparkSession.sparkContext.broadcast((local["row_id"].to_numpy(), matrix(local["vec"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, d = shared.value
        for pdf in batches:
            if not len(pdf) or not len(rows):
                continue
            step = max(1, STEP // len(rows))
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                pos = part["query_pos"].to_numpy()
                q, j, s = _top(matrix(part["vec"]) @ d.T, rows, k, pos if exclude_self else None)
                yield _frame(pos[q], rows[j], s)

    return queries.select("query_pos", as_double(F.col("vec")).alias("vec")).mapInPandas(search, SCHEMA)


def grid(queries: int, rows: int, dim: int, parallelism: int, block_rows: int | None = None) -> tuple[int, int]:
    """``(query cuts, index blocks)``: blocks within ``TASK_BYTES`` (or ``block_rows``), and two tasks a core, with the fewest copies."""
    most = block_rows or max(1, TASK_BYTES // (8 * max(dim, 1)))
    cuts, blocks = max(1, -(-queries // most)), max(1, -(-rows // most))
    while cuts * blocks < 2 * parallelism and (cuts < queries or blocks < rows):
        # a further cut copies the other side once more
        if cuts < queries and (rows <= queries or blocks >= rows):
            cuts += 1
        else:
            blocks += 1
        if block_rows:
            break
    return cuts, blocks


def _two_phase(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool, rows: int, dim: int, block_rows: int | None) -> DataFrame:
    cuts, blocks = grid(queries.count(), rows, dim, queries.sparkSession.sparkContext.defaultParallelism, block_rows)
    d = index.select("row_id", as_double(F.col("vec")).alias("vec"), F.pmod(F.xxhash64("row_id"), F.lit(blocks)).alias("b"))
    d = d.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    q = queries.select("query_pos", as_double(F.col("vec")).alias("vec"), F.pmod(F.xxhash64("query_pos"), F.lit(cuts)).cast("int").alias("c"))
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("row_id")
        if not len(left) or not len(right):
            return _frame(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        pos, ids = left["query_pos"].to_numpy(), right["row_id"].to_numpy()
        m, d = matrix(left["vec"]), matrix(right["vec"])
        step = max(1, STEP // len(ids))
        parts = []
        for i in range(0, len(pos), step):
            own = pos[i : i + step]
            a, j, s = _top(m[i : i + step] @ d.T, ids, k, own if exclude_self else None)
            parts.append(_frame(own[a], ids[j], s))
        return pd.concat(parts)

    local = q.groupBy("b", "c").cogroup(d.groupBy("b", "c")).applyInPandas(search, SCHEMA)
    best = Window.partitionBy("query_pos").orderBy(F.desc("similarity"), "db_row")
    return local.drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_pos", "rank", "db_row", "similarity", "distance")


def knn_join(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = False, strategy: str = "auto", block_rows: int | None = None) -> DataFrame:
    """The ``k`` most similar index rows of every query; fewer where the index has fewer.

    ``exclude_self`` leaves out the row whose ``row_id`` is the query's position.
    Null vectors take no part on either side.  An empty index or no queries give
    no rows.
    """
    queries = queries.where(F.col("vec").isNotNull())
    index = index.where(F.col("vec").isNotNull())
    if strategy == "expression":
        return _expression(queries, index, k, exclude_self)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if strategy == "auto":
        strategy = "block" if size["n"] * (size["d"] or 0) * 8 <= BROADCAST_BYTES else "two_phase"
    if strategy == "block":
        return _block(queries, index, k, exclude_self)
    return _two_phase(queries, index, k, exclude_self, size["n"], size["d"] or 0, block_rows)


def padded(neighbours: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_pos, rank, db_row, similarity`` with exactly ``k`` rows per query: missing places have row -1 and similarity 0."""
    places = queries.select("query_pos", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return places.join(neighbours.select("query_pos", "rank", "db_row", "similarity"), ["query_pos", "rank"], "left").select(
        "query_pos", "rank", F.coalesce("db_row", F.lit(-1)).cast("bigint").alias("db_row"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )
