"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import reference, scale

_PARTS = [reference, scale]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """k-NN annotation: neighbours, cutoff, majority vote, confidence."""
    return reference.knn_vote_k5(spark, folder)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
