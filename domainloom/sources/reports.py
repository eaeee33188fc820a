"""Parameters in force, read from the long-form reports of past split runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import report_number


def in_force(split_summary: DataFrame) -> DataFrame:
    """``report, section, item, value``: the items of the run with the latest ``run_at``.

    Ties in ``run_at`` go to the larger ``run_id``; repeated rows count once;
    an item without a readable number has a null value.  The table holds a
    fixed number of report items, not data rows.
    """
    clean = split_summary.select(
        "run_id", "run_at", F.trim("report").alias("report"), F.trim("section").alias("section"),
        F.trim("item").alias("item"), report_number(F.col("val")).alias("value"),
    )
    latest = clean.agg(F.max(F.struct("run_at", "run_id")).alias("m")).select(F.col("m.run_at").alias("_at"), F.col("m.run_id").alias("_run"))
    rows = clean.join(F.broadcast(latest), (F.col("run_at") == F.col("_at")) & (F.col("run_id") == F.col("_run")))
    return rows.groupBy("report", "section", "item").agg(F.max("value").alias("value"))


def parameters(split_summary: DataFrame, section: str = "params") -> dict[str, float]:
    """All parameters in force that have a readable number; the reports hold a fixed number of items."""
    rows = in_force(split_summary).where(F.col("section") == section).groupBy("item").agg(F.max("value").alias("value")).collect()
    return {r["item"]: float(r["value"]) for r in rows if r["value"] is not None}


def parameter(split_summary: DataFrame, item: str, default: float | None = None, section: str = "params") -> float:
    """One parameter in force as a number; ``default`` where the run has none."""
    found = parameters(split_summary, section).get(item, default)
    if found is None:
        raise ValueError(f"no value of {item} is in force")
    return found
