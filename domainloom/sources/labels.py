"""Label lines: "id label [extra ...]"; ``#`` in column 0 comments; the last line of an id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import domain_of


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """``pos, id, label`` of every valid line of ``lines (pos, line)``.

    Comments, lines with fewer than two tokens and null lines are dropped, extra
    tokens ignored.
    """
    tokens = F.filter(F.split(F.col("line"), r"\s+"), lambda x: x != "")
    return (
        lines.where(F.col("line").isNotNull() & ~F.col("line").startswith("#"))
        .select("pos", tokens.alias("_t"))
        .where(F.size("_t") >= 2)
        .select("pos", F.get("_t", F.lit(0)).alias("id"), F.get("_t", F.lit(1)).alias("label"))
    )


def label_table(lines: DataFrame, key: str = "id") -> DataFrame:
    """``(key, label)``: the label of each id's last line; ``key="domain"`` takes ids by their domain."""
    parsed = parse_label_lines(lines)
    if key == "domain":
        parsed = parsed.select("pos", domain_of(F.col("id")).alias("domain"), "label").where(F.col("domain").isNotNull())
    return parsed.groupBy(key).agg(F.max_by("label", "pos").alias("label"))


def label_vocabulary(lines: DataFrame) -> DataFrame:
    """``(label, label_idx)``: labels numbered by their first appearance, labels that a later line replaced included.

    The numbering window holds one row per distinct label, not per line.
    """
    from pyspark.sql import Window

    first = parse_label_lines(lines).groupBy("label").agg(F.min("pos").alias("_first"))
    return first.select("label", (F.row_number().over(Window.orderBy("_first")) - 1).cast("bigint").alias("label_idx"))


def with_superfamily(records: DataFrame, label_lines: DataFrame, vocab: DataFrame, out: str = "superfamily") -> DataFrame:
    """``records`` with ``domain`` and ``out``: the record's ``label_idx`` or, where null, the index its domain's last line gives.

    Only the records without an index are shuffled to the label lines; the others
    pass by, so neither a hot label nor the empty key gathers in one task.  A
    domain has one row on the label side.  Columns ``domain`` and ``out`` of the
    input are replaced.
    """
    base = records.drop(out, "domain").withColumn("domain", domain_of(F.col("id")))
    by_domain = (
        label_table(label_lines, "domain")
        .join(vocab.groupBy("label").agg(F.min("label_idx").alias("_idx")), "label")
        .select(F.col("domain").alias("_domain"), "_idx")
    )
    has = F.col("label_idx").isNotNull() | F.col("domain").isNull()
    direct = base.where(has).withColumn(out, F.col("label_idx"))
    looked_up = (
        base.where(~has).join(by_domain, F.col("domain") == F.col("_domain"), "left")
        .withColumn(out, F.col("_idx")).drop("_domain", "_idx")
    )
    return direct.unionByName(looked_up)
