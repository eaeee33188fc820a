"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are counted per (input partition, key), the counts are prefix-summed to
offsets, and each row's offset plus its place in its partition is its number
within the key.  Equal runs of numbers form chunks; every chunk is processed where its
rows are and the chunks' states are merged in order, level by level.  No task ever
gathers more than one chunk's states or one bundle of them, however large a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stage

CHUNK_ROWS = 20_000
BROADCAST_OFFSETS = 500_000
MERGE_ROWS = 20_000


def key_codes(column: pa.ChunkedArray | pa.Array, known: dict) -> np.ndarray:
    """A dense code per value of ``column``, the same for equal values of all calls with one ``known``; null is a value.

    Values never pass through floating point, so integers of any size stay apart.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode(null_encoding="encode")
    # NaN is no key of a dict, but one key of Spark's
    values = ["NaN" if isinstance(v, float) and v != v else v for v in coded.dictionary.to_pylist()]
    own = np.array([known.setdefault((type(v) is str, v), len(known)) for v in values], dtype=np.int64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def _places(codes: np.ndarray) -> np.ndarray:
    """Each entry's 0-based place among the equal ones."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    at = np.arange(len(codes))
    out = np.empty(len(codes), dtype=np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def _number_in_partition(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``_nr_place`` to Arrow batches; the rows themselves pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = key_codes(batch.column(key), known)
            seen = np.r_[seen, np.zeros(len(known) - len(seen), dtype=np.int64)]
            place = _places(codes) + seen[codes]
            seen += np.bincount(codes, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "_nr_place"])

    return run


def number_rows(rows: DataFrame, key: str, out: str = "row_number") -> DataFrame:
    """``rows`` with ``out``: 0-based numbers within each ``key``, dense and unique, with no shuffle on the key.

    The rows are written once (so that both passes see the same partitions) with
    their partition and place; the offsets are a table of one row per
    (partition, key).  It is broadcast only while it has at most
    ``BROADCAST_OFFSETS`` rows, a count taken before; beyond that it is joined by
    shuffle on (partition, key), whose groups are no larger than a partition.
    Null keys are a key of their own; an empty input gives an empty result; a
    column named ``out`` is replaced.  Rows pass Python as Arrow batches only, so no
    value of any column changes, and keys are compared exactly.
    """
    rows = rows.drop(out, "_nr_part", "_nr_place")
    schema = T.StructType([*rows.schema.fields, T.StructField("_nr_part", T.IntegerType()), T.StructField("_nr_place", T.LongType())])
    placed = stage(rows.withColumn("_nr_part", F.spark_partition_id()).mapInArrow(_number_in_partition(key), schema))
    counts = stage(placed.groupBy("_nr_part", key).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(key).orderBy("_nr_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_nr_part").alias("_nr_p"), F.col(key).alias("_nr_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nr_offset")
    )
    if counts.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    joined = placed.join(offsets, (F.col("_nr_part") == F.col("_nr_p")) & F.col(key).eqNullSafe(F.col("_nr_key")))
    return joined.withColumn(out, F.col("_nr_place") + F.col("_nr_offset")).drop("_nr_p", "_nr_key", "_nr_offset", "_nr_part", "_nr_place")


def frame_of(table: pa.Table) -> pd.DataFrame:
    """``table`` in pandas, integer columns with nulls as nullable integers instead of floats."""
    return pd.DataFrame({
        name: column.to_pandas(types_mapper={column.type: pd.Int64Dtype()}.get) if pa.types.is_integer(column.type) and column.null_count else column.to_pandas()
        for name, column in zip(table.schema.names, table.columns)
    })


def chunked_by_key(
    rows: DataFrame,
    key: str,
    states: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    merge: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    state_schema: str,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = 256,
) -> DataFrame:
    """``key`` and the merged state of each key's rows, in the order of their numbers.

    ``states(pdf, piece)`` gets an ordered batch of rows and the piece each belongs
    to (0-based codes in the order of first appearance) and gives one row of
    ``state_schema`` per piece; a piece is what one batch holds of one chunk of
    one key.  It runs where the rows are, so only states are shuffled.
    ``merge(pdf, group)`` turns the ordered states of each group into one row: first
    those of a chunk (at most ``chunk_rows``), then bundles of ``fan_in`` chunks,
    level by level.  Groups are merged many at a time, in buckets of about
    ``MERGE_ROWS`` states; a bucket exceeds that by no more than one group.
    """
    fields = T._parse_datatype_string(state_schema).fields
    names = [f.name for f in fields]
    head = [T.StructField(key, rows.schema[key].dataType), T.StructField("_chunk", T.LongType()), T.StructField("_first", T.LongType())]
    schema = T.StructType([*head, *fields])
    wanted = to_arrow_schema(schema)
    numbered = number_rows(rows, key, "_number")

    def groups(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The rows in order, the group (key and chunk) of each by first appearance, and the first row of each group."""
        codes = key_codes(table.column(key), {})
        chunk = table.column("_chunk").to_numpy()
        group, ids = pd.factorize(codes * (int(chunk.max()) + 1) + chunk)
        at = np.zeros(len(ids), dtype=np.int64)
        at[group[::-1]] = np.arange(len(group))[::-1]
        return table, group, at

    def answer(table: pa.Table, at: np.ndarray, states: pd.DataFrame) -> pa.Table:
        lead = table.select([key, "_chunk", "_first"]).take(pa.array(at))
        body = pa.Table.from_pandas(states[names], preserve_index=False)
        return pa.table({**dict(zip(lead.schema.names, lead.columns)), **dict(zip(names, body.columns))}).cast(wanted)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).sort_by("_number")
            number = rows.column("_number")
            rows = rows.append_column("_chunk", pa.array(number.to_numpy() // chunk_rows, pa.int64())).append_column("_first", number)
            rows, piece, at = groups(rows)
            yield from answer(rows, at, states(frame_of(rows), piece)).to_batches()

    def bucket(table: pa.Table) -> pa.Table:
        rows, group, at = groups(table.drop_columns(["_bucket"]).sort_by([("_chunk", "ascending"), ("_first", "ascending")]))
        return answer(rows, at, merge(frame_of(rows), group))

    def merged(states: DataFrame) -> DataFrame:
        buckets = max(1, states.count() // MERGE_ROWS)
        return states.withColumn("_bucket", F.pmod(F.xxhash64(key, "_chunk"), F.lit(buckets))).groupBy("_bucket").applyInArrow(bucket, schema)

    now = stage(merged(stage(numbered.mapInArrow(pieces, schema))))
    most = now.agg(F.max("_chunk")).first()[0] or 0
    while most > 0:
        now = stage(merged(now.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("bigint"))))
        most //= fan_in
    return now.drop("_chunk", "_first")


def superfamily_profiles(records: DataFrame, key: str = "superfamily", chunk_rows: int = CHUNK_ROWS, dim: int = 64) -> DataFrame:
    """Per ``key``: ``records``, ``usable`` vectors, distinct non-null ``sources``, and the ``mean`` of the usable vectors.

    Input columns: ``key, source, embedding``; others are ignored.  Rows of a null
    key are dropped.  A vector counts as usable with ``dim`` values, no null or
    NaN among them, not all zero; a key without one has a null mean.  Repeated
    rows count each time; an empty input gives no rows.
    """
    known = records.where(F.col(key).isNotNull())
    sources = (
        known.where(F.col("source").isNotNull()).groupBy(key, "source").agg(F.lit(1).alias("_one"))
        .groupBy(key).agg(F.count("_one").alias("sources"))
    )

    def states(pdf: pd.DataFrame, piece: np.ndarray) -> pd.DataFrame:
        n = int(piece.max()) + 1
        fits = np.array([v is not None and len(v) == dim for v in pdf["embedding"]], dtype=bool)
        m = np.concatenate(pdf["embedding"][fits].to_numpy()).astype(np.float64).reshape(-1, dim) if fits.any() else np.empty((0, dim))
        good = ~np.isnan(m).any(axis=1) & (m != 0).any(axis=1)
        m, of = m[good], piece[fits][good]
        total = np.zeros((n, dim))
        np.add.at(total, of, m)
        return pd.DataFrame({"records": np.bincount(piece, minlength=n), "usable": np.bincount(of, minlength=n), "total": list(total)})

    def merge(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        n = int(group.max()) + 1
        out = {c: np.zeros(n, dtype=np.int64) for c in ("records", "usable")}
        for c, to in out.items():
            np.add.at(to, group, pdf[c].to_numpy())
        total = np.zeros((n, dim))
        np.add.at(total, group, np.array(pdf["total"].tolist(), dtype=np.float64).reshape(-1, dim))
        return pd.DataFrame(out | {"total": list(total)})

    schema = "records bigint, usable bigint, total array<double>"
    merged = chunked_by_key(known.select(key, "embedding"), key, states, merge, schema, chunk_rows)
    return merged.join(sources, key, "left").select(
        key, "records", "usable", F.coalesce("sources", F.lit(0)).cast("bigint").alias("sources"),
        F.when(F.col("usable") > 0, F.transform("total", lambda x: x / F.col("usable"))).alias("mean"),
    )
