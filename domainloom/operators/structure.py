"""Structural scores of top hits: report parsing, file lookup, external runs."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paths

#: Structure files of a domain, in order of preference (fixed values).
EXTENSIONS = (".pdb", ".cif", ".pdb.gz", ".cif.gz", ".ent", ".ent.gz")
TIMEOUT_SECONDS = 120
# Patterns of the report format (fixed values): aligned length and RMSD stand side by side.
_ALIGNED = r"Aligned length=\s*(\d+),\s*RMSD=\s*[\d.]+"
_RMSD = r"Aligned length=\s*\d+,\s*RMSD=\s*([\d.]+)"
_LENGTH = r"Length of Chain_1:\s*(\d+)\s*residues"
_SCORE = r"TM-score=\s*([\d.]+)\s*\(if normalized by length of Chain_1"


def parse_report(text: Column) -> dict[str, Column]:
    """``tm_score, rmsd, aligned_length, query_length, coverage`` of an aligner's report; all null where any part is absent.

    Coverage is aligned over query length, 0 for a query of no length.
    """
    part = {name: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for name, pattern in (("a", _ALIGNED), ("r", _RMSD), ("l", _LENGTH), ("s", _SCORE))}
    whole = part["a"].isNotNull() & part["r"].isNotNull() & part["l"].isNotNull() & part["s"].isNotNull()
    aligned, length = part["a"].cast("int"), part["l"].cast("int")
    return {
        "tm_score": F.when(whole, part["s"].cast("double")), "rmsd": F.when(whole, part["r"].cast("double")),
        "aligned_length": F.when(whole, aligned), "query_length": F.when(whole, length),
        "coverage": F.when(whole, F.when(length > 0, aligned / length).otherwise(F.lit(0.0))),
    }


def parse_text(text: str) -> tuple[float, float, float]:
    """``(tm_score, rmsd, coverage)``; raises ValueError where a part is absent."""
    found = [re.search(p, text) for p in (_ALIGNED, _RMSD, _LENGTH, _SCORE)]
    if not all(found):
        raise ValueError("not an aligner report")
    aligned, rmsd, length, score = (m.group(1) for m in found)
    return float(score), float(rmsd), int(aligned) / int(length) if int(length) else 0.0


def structure_files(spark: SparkSession, folder: str | Path) -> DataFrame:
    """``id, ext, path`` of the structure files of a folder."""
    rows = []
    for name in paths.names(folder):
        ext = max((e for e in EXTENSIONS if name.endswith(e)), key=len, default=None)
        if ext:
            rows.append((name[: -len(ext)], ext, paths.join(folder, name)))
    return spark.createDataFrame(rows, "id string, ext string, path string")


def preferred(files: DataFrame) -> DataFrame:
    """``id, path``: of each id the file whose extension comes first in ``EXTENSIONS``; other extensions do not count."""
    rank = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("ext"))
    return files.where(rank > 0).groupBy("id").agg(F.min_by("path", rank).alias("path"))


def resolvable(hits: DataFrame, files: DataFrame) -> DataFrame:
    """``hits (query_id, target_id, ...)`` with ``query_path`` and ``target_path``, where both sides have a structure."""
    best = preferred(files)
    q = best.select(F.col("id").alias("query_id"), F.col("path").alias("query_path"))
    t = best.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    return hits.join(q, "query_id").join(t, "target_id")


def find_binary(name: str = "TMalign") -> str:
    """An executable given by path or found on the search path; raises where there is none."""
    found = name if os.sep in name and os.access(name, os.X_OK) else shutil.which(name)
    if not found:
        raise FileNotFoundError(f"no executable {name}")
    return found


def score_structures(pairs: DataFrame, binary: str = "TMalign", timeout: float = TIMEOUT_SECONDS) -> DataFrame:
    """``query_pos, tm_score, rmsd, tm_coverage, failure`` of ``pairs (query_pos, query_path, target_path)``.

    One external run per pair on the executors; a failed run, an unreadable report
    or a timeout leaves the scores null and says why.  Nothing is reordered.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = find_binary(binary)
        for pdf in frames:
            rows = []
            for pos, q, t in zip(pdf["query_pos"], pdf["query_path"], pdf["target_path"]):
                try:
                    done = subprocess.run([program, q, t], capture_output=True, text=True, timeout=timeout)
                    if done.returncode:
                        rows.append((pos, None, None, None, f"exit {done.returncode}"))
                    else:
                        rows.append((pos, *parse_text(done.stdout), None))
                except subprocess.TimeoutExpired:
                    rows.append((pos, None, None, None, "timeout"))
                except (OSError, ValueError) as e:
                    rows.append((pos, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["query_pos", "tm_score", "rmsd", "tm_coverage", "failure"])

    return pairs.select("query_pos", "query_path", "target_path").mapInPandas(run, "query_pos bigint, tm_score double, rmsd double, tm_coverage double, failure string")


def attach_scores(predictions: DataFrame, index: DataFrame, files: DataFrame, binary: str = "TMalign", timeout: float = TIMEOUT_SECONDS) -> DataFrame:
    """Predictions with structural scores of annotated rows whose query and nearest row both have a structure; null elsewhere."""
    from .annotate import top_hits

    scores = score_structures(resolvable(top_hits(predictions, index), files), binary, timeout).drop("failure")
    return predictions.drop("tm_score", "rmsd", "tm_coverage").join(scores, "query_pos", "left")
