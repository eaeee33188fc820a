"""Results as files: predictions and curves as TSV, metrics as JSON, indexes as Parquet."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import half_precision, l2_normalize
from . import paths


def prediction_columns(truth: bool = False, distance: bool = False, confidence: bool = False, structure: bool = False) -> list[str]:
    """Columns of a prediction report in their fixed order."""
    return ["query_id", "predicted_annotation", *["true_annotation"] * truth, *["distance"] * distance, *["confidence"] * confidence, *["tm_score", "rmsd", "tm_coverage"] * structure]


def write_tsv(rows: DataFrame, path: str | Path, columns: list[str] | None = None) -> str:
    """One TSV file with a header and CRLF line ends, null as empty; written beside its place and moved there.

    Rows stream to the driver partition by partition in the DataFrame's order.  For
    results that should stay distributed, ``write_tsv_parts`` writes a folder.
    """
    columns = columns or rows.columns

    def lines() -> Iterator[str]:
        held = io.StringIO()
        w = csv.writer(held, delimiter="\t")
        w.writerow(columns)
        for r in rows.select(*columns).toLocalIterator(prefetchPartitions=True):
            w.writerow(["" if v is None else v for v in r])
            yield held.getvalue()
            held.seek(0)
            held.truncate()
        yield held.getvalue()

    return paths.write_lines(path, lines())


def read_tsv(spark: SparkSession, path: str | Path, schema: str) -> DataFrame:
    """A report of ``write_tsv`` or ``write_tsv_parts`` whose columns must be those of ``schema``; empty cells are null."""
    options = {"sep": "\t", "header": True, "nullValue": "", "enforceSchema": False, "escape": '"', "nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf"}
    return spark.read.options(**options).schema(schema).csv(paths.text_of(path))


def write_tsv_parts(rows: DataFrame, path: str | Path, columns: list[str] | None = None) -> None:
    """A folder of TSV parts, each with a header; order is kept within and across part numbers."""
    rows.select(*(columns or rows.columns)).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(path))


def write_metrics(row: DataFrame, path: str | Path) -> str:
    """The one row of ``row`` as indented JSON."""
    return paths.write_text(path, json.dumps(row.first().asDict(recursive=True), indent=2))


def build_index(rows: DataFrame, labels: DataFrame | None = None, half: bool = False) -> DataFrame:
    """``row_id, id, label, vec`` of ``rows (row_id, id, vec)``: unit vectors, rounded to half precision on request before the norm."""
    from ..operators.annotate import index_labels

    vec = half_precision(F.col("vec")) if half else F.col("vec")
    unit = rows.withColumn("vec", vec).withColumn("vec", l2_normalize(F.col("vec")).cast("array<float>"))
    if labels is None:
        return unit.select("row_id", "id", F.lit(None).cast("string").alias("label"), "vec")
    return unit.select("row_id", "vec").join(index_labels(rows.select("row_id", "id"), labels), "row_id").select("row_id", "id", "label", "vec")


def write_index(index: DataFrame, path: str | Path, overwrite: bool = False) -> None:
    index.write.mode("overwrite" if overwrite else "errorifexists").parquet(str(path))


def read_index(spark: SparkSession, path: str | Path) -> DataFrame:
    """The stored index; its vectors are trusted to be normalized."""
    return spark.read.parquet(str(path))


def unknown_labels(index: DataFrame) -> DataFrame:
    """One row ``rows, unknown`` of an index."""
    return index.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == "unknown").alias("unknown"))


def index_size(index: DataFrame) -> DataFrame:
    """One row ``rows, dim``; the width is that of the widest vector, null for an empty index."""
    return index.agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("vec").isNotNull(), F.size("vec"))).alias("dim"))
