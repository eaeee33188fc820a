"""FASTA text as DataFrames: ``lines (file, pos, line)`` from files or tables, ids, and assembled sequences.

``pos`` is unique and ordered within a file; files are ordered by name unless the
caller passes ``file_order``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import header_token
from . import paths

#: Positions of a chunk (lines of a table, bytes of a file), and chunks of a group.
LINES_PER_CHUNK, CHUNKS_PER_GROUP = 50_000, 20_000


def resolve_paths(source: str | Path) -> dict[str, str]:
    """``{stem: path}`` of a FASTA file, or of a folder's ``*.fasta`` and then ``*.fa`` files, each sorted; empty if there are none."""
    if paths.is_file(source):
        return {paths.stem_of(source): paths.text_of(source)}
    found = paths.names(source)
    return {paths.stem_of(n): paths.join(source, n) for end in (".fasta", ".fa") for n in found if n.endswith(end)}


def require_paths(sources: str | Path | list[str | Path]) -> list[str]:
    """The paths of one or many files or folders in the caller's order; raises where one has no FASTA file."""
    many = sources if isinstance(sources, (list, tuple)) else [sources]
    out: list[str] = []
    for s in many:
        found = list(resolve_paths(s).values())
        if not found:
            raise FileNotFoundError(f"no FASTA file at {s}")
        out += found
    return out


def read_text(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, file_order, pos, line`` of text files in the order given, without carriage returns.

    Files may lie on any file system that Spark reads; local ones are named without
    a scheme.  The position joins a line's file block and its place in it, so files are read
    in splits and still keep their order; a line is at least one byte, so the
    places of one block stay below the start of the next.
    """
    order = F.create_map(*[F.lit(x) for i, p in enumerate(files) for x in (paths.qualified(p), i)])
    rows = spark.read.text([paths.text_of(p) for p in files]).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_m"))
    first = rows.groupBy("file_path", "file_block_start").agg(F.min("_m").alias("_first"))
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("file_path", r"^file:/*", "/"), r"\+", "%2B"))
    return rows.join(first, ["file_path", "file_block_start"]).select(
        plain.alias("file"), F.element_at(order, plain).alias("file_order"),
        (F.col("file_block_start") + F.col("_m") - F.col("_first")).alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"),
    )


def read_lines(spark: SparkSession, sources: str | Path | list[str | Path]) -> DataFrame:
    """The lines of FASTA files or folders of them, as ``read_text`` gives them."""
    return read_text(spark, require_paths(sources))


def header_ids(lines: DataFrame) -> DataFrame:
    """``file, pos, id`` of the lines that begin with ``>``: repeated ids kept, indented headers no headers, bare ``>`` dropped."""
    heads = lines.where(F.col("line").startswith(">")).select("file", "pos", header_token(F.col("line")).alias("id"))
    return heads.where(F.col("id") != "")


def _starts(lines: DataFrame, is_header: Column) -> DataFrame:
    """``lines`` with ``start``: the position of the last header at or before each line of its file; null before the first.

    Files are worked in chunks of positions, and chunks in groups of as many: what
    a chunk inherits comes from the chunks before it in its group and from a row
    per group, so neither the lines nor the chunks of a large file are one task.
    """
    chunked = lines.withColumn("_chunk", F.floor(F.col("pos") / LINES_PER_CHUNK)).withColumn("_head", F.when(is_header, F.col("pos")))
    last = chunked.groupBy("file", "_chunk").agg(F.max("_head").alias("_last")).withColumn("_group", F.floor(F.col("_chunk") / CHUNKS_PER_GROUP))
    groups = last.groupBy("file", "_group").agg(F.max("_last").alias("_of_group"))
    earlier = Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file", "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = last.withColumn("_within", F.max("_last").over(before)).join(
        groups.select("file", "_group", F.max("_of_group").over(earlier).alias("_before")), ["file", "_group"]
    ).select("file", "_chunk", F.coalesce("_within", "_before").alias("_inherited"))
    so_far = Window.partitionBy("file", "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("_own", F.max("_head").over(so_far)).join(inherited, ["file", "_chunk"])
        .withColumn("start", F.coalesce("_own", "_inherited")).drop("_chunk", "_head", "_own", "_inherited")
    )


def sequences(lines: DataFrame, first_wins: bool = True) -> DataFrame:
    """``file, pos, id, sequence, length``: one row per record, or per id where the first record wins.

    Lines are stripped before anything else, so indented headers count here; blank
    lines and lines before the first header are skipped, ``-`` is deleted, lines
    are joined in order.  A header without a body has an empty sequence; a bare
    ``>`` begins a record without id, which is dropped.  Null lines are skipped.
    """
    order = "file_order" if "file_order" in lines.columns else "file"
    stripped = lines.select("file", order, "pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")) if order != "file" else lines.select(
        "file", "pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")
    )
    kept = stripped.where(F.col("line").isNotNull() & (F.col("line") != ""))
    is_header = F.col("line").startswith(">")
    parts = _starts(kept, is_header).where(F.col("start").isNotNull())
    head = F.max(F.when(is_header, header_token(F.col("line"))))
    body = F.sort_array(F.collect_list(F.when(~is_header, F.struct("pos", "line"))))
    records = parts.groupBy("file", *([order] if order != "file" else []), "start").agg(
        head.alias("id"), F.translate(F.array_join(body.getField("line"), ""), "-", "").alias("sequence")
    ).where(F.col("id") != "")
    if first_wins:
        earliest = records.groupBy("id").agg(F.min_by(F.struct("file", "start", "sequence"), F.struct(order, "start")).alias("r"))
        records = earliest.select("id", "r.file", "r.start", "r.sequence")
    return records.select("file", F.col("start").alias("pos"), "id", "sequence", F.length("sequence").alias("length"))


def allowed(ids: DataFrame, allow: list[str] | DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in the allow-list; order columns and duplicates kept.  A list becomes a literal, a DataFrame a semi-join."""
    if isinstance(allow, DataFrame):
        return ids.join(allow.select(F.col(allow.columns[0]).alias(column)).distinct(), column, "left_semi")
    return ids.where(F.col(column).isin(allow))
