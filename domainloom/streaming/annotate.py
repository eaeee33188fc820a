"""Annotation of arriving queries: each micro-batch is annotated against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate


def annotate_stream(queries: DataFrame, index: DataFrame, path: str, checkpoint: str, k: int = 1, distance_cutoff: float = 1.0, strategy: str = "auto", trigger_once: bool = False) -> StreamingQuery:
    """Appends predictions of the stream ``queries (query_pos, query_id, vec)`` to the Parquet folder ``path``.

    A batch is written to its own ``batch=N`` folder, which a replay overwrites, so
    a restart from ``checkpoint`` gives every batch once.
    """

    def one(batch: DataFrame, number: int) -> None:
        annotate(batch, index, k, distance_cutoff, strategy=strategy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()
