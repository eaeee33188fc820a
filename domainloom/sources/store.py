"""Embedding stores: Parquet tables with a JSON sidecar, an importer for array folders, and the resolver that reads or makes one.

A store is ``row_id bigint, id string, embedding array<float>[, label_idx bigint]``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import number_rows
from . import paths
from .fasta import read_text

METADATA = "metadata.json"
TABLE = "embeddings.parquet"
#: Names under which a sidecar may give a value (fixed values).
ALIASES = {
    "dim": ("dims", "dim", "embedding_dim"),
    "count": ("count", "num_embeddings", "n_embeddings"),
    "dtype": ("dtype",),
}


def metadata_value(metadata: dict, key: str):
    """The first of the key's aliases that is present, else None."""
    return next((metadata[name] for name in ALIASES.get(key, (key,)) if name in metadata), None)


def metadata_column(raw, key: str):
    """The same over a column of JSON text: a string column, null where no alias is present."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{name}") for name in ALIASES.get(key, (key,))])


def label_map(raw) -> DataFrame:
    """``array<struct<key, value>>`` of a JSON column holding ``{"idx_to_label": {...}}``."""
    return F.map_entries(F.from_json(F.get_json_object(raw, "$.idx_to_label"), "map<string,string>"))


def read_ids(lines: DataFrame, column: str = "line") -> DataFrame:
    """``pos, id`` of an id list: stripped lines, blank ones dropped."""
    return lines.select("pos", F.regexp_replace(column, r"^\s+|\s+$", "").alias("id")).where(F.col("id") != "")


def last_rows(store: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """``id, row_id``: the last row of every non-null id, or the row that ``override (id, row_id)`` names, which then is all there is."""
    if override is not None:
        return override.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("row_id").alias("row_id"))
    return store.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("row_id").alias("row_id"))


def gather(ids: DataFrame, store: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """``query_pos, id, embedding`` as floats for the ids found, repeated queries included."""
    rows = ids.join(last_rows(store, override), "id").join(store.select("row_id", "embedding"), "row_id")
    return rows.select("query_pos", "id", F.col("embedding").cast("array<float>").alias("embedding"))


def class_count(vocabulary: DataFrame) -> DataFrame:
    """One row ``classes``, classes without rows included."""
    return vocabulary.agg(F.count(F.lit(1)).alias("classes"))


def fallback_vocabulary(store: DataFrame) -> DataFrame:
    """``label_idx, label``: each distinct non-null label index named by its number, for stores without a vocabulary."""
    return store.where(F.col("label_idx").isNotNull()).select("label_idx").distinct().withColumn("label", F.col("label_idx").cast("string"))


def check(store: DataFrame, metadata: dict | None = None, require_labels: bool = False) -> None:
    """Raises ValueError where widths differ, ids are null, or count, width or labels disagree with the metadata."""
    labels = F.count("label_idx") if "label_idx" in store.columns else F.lit(0)
    r = store.agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
        F.count("embedding").alias("vectors"), labels.alias("labels"),
    ).first()
    if r["ids"] != r["n"] or r["vectors"] != r["n"]:
        raise ValueError("ids and embeddings must not be null")
    if r["lo"] != r["hi"]:
        raise ValueError(f"embeddings of {r['lo']} to {r['hi']} values")
    if require_labels and ("label_idx" not in store.columns or r["labels"] != r["n"]):
        raise ValueError("the store has no labels")
    count, dim = (metadata_value(metadata or {}, k) for k in ("count", "dim"))
    if count is not None and int(count) != r["n"]:
        raise ValueError(f"{r['n']} rows, metadata says {count}")
    if dim is not None and r["lo"] is not None and int(dim) != r["lo"]:
        raise ValueError(f"{r['lo']} values, metadata says {dim}")


def is_populated(path: str | Path) -> bool:
    return paths.exists(paths.join(path, TABLE)) and paths.exists(paths.join(path, METADATA))


def write_store(store: DataFrame, path: str | Path, source: str | None = None, extra: dict | None = None, vocabulary: dict[int, str] | None = None, overwrite: bool = False) -> str:
    """Writes the table and then its sidecar; refuses a folder that holds either, unless ``overwrite``.

    Rows are committed by the writer at once; a folder with a table but no sidecar
    is an unfinished store and is not read.
    """
    rows, about_file = paths.join(path, TABLE), paths.join(path, METADATA)
    if not overwrite and (paths.exists(rows) or paths.exists(about_file)):
        raise FileExistsError(f"{path} holds a store")
    paths.remove(about_file)
    store.write.mode("overwrite" if overwrite else "errorifexists").parquet(rows)
    r = store.sparkSession.read.parquet(rows).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    about = {"dim": r["d"], "count": r["n"], "dtype": "float32", "source": source} | (extra or {})
    if vocabulary is not None:
        about["idx_to_label"] = {str(k): v for k, v in vocabulary.items()}
    paths.write_text(about_file, json.dumps(about, indent=2))
    return paths.text_of(path)


def read_store(spark: SparkSession, path: str | Path, require_labels: bool = False) -> tuple[DataFrame, dict]:
    """The table and its metadata, checked against each other."""
    if not is_populated(path):
        raise FileNotFoundError(f"no store at {path}")
    about = json.loads(paths.read_text(paths.join(path, METADATA)))
    df = spark.read.parquet(paths.join(path, TABLE))
    check(df, about, require_labels)
    return df, about


def vocabulary_of(path: str | Path, metadata: dict) -> dict[int, str] | None:
    """Label names by index: inline in the metadata, in the sidecar file it names, or None."""
    inline = metadata.get("idx_to_label")
    if inline is None and metadata.get("idx_to_label_file"):
        inline = json.loads(paths.read_text(paths.join(path, metadata["idx_to_label_file"])))
    return None if inline is None else {int(k): v for k, v in inline.items()}


def import_arrays(spark: SparkSession, folder: str | Path, rows_per_part: int = 65_536, require_labels: bool = False) -> DataFrame:
    """A store from ``embeddings.npy``, ``ids.txt``, ``metadata.json`` and, if present, ``labels.npy``; nothing pickled is read.

    The three files must be there, and rows, width and type (where the metadata
    names them), ids and labels must agree.  Executors map the array file and read
    their own rows, so the folder must be mounted on all of them (``file:`` is
    understood, other file systems are not); ids are numbered range by range in
    file order.
    """
    p = Path(paths.qualified(folder))
    for name in ("embeddings.npy", "ids.txt", METADATA):
        if not (p / name).exists():
            raise FileNotFoundError(f"no {name} in {folder}")
    mapped = np.load(p / "embeddings.npy", mmap_mode="r", allow_pickle=False)
    if mapped.ndim != 2:
        raise ValueError(f"embeddings of {mapped.ndim} dimensions")
    shape, dtype = mapped.shape, mapped.dtype
    about = json.loads((p / METADATA).read_text())
    for key, found in (("count", shape[0]), ("dim", shape[1])):
        said = metadata_value(about, key)
        if said is not None and int(said) != found:
            raise ValueError(f"{key} {found}, metadata says {said}")
    said = metadata_value(about, "dtype")
    if said is not None and np.dtype(said) != dtype:
        raise ValueError(f"type {dtype}, metadata says {said}")
    array, labels = str(p / "embeddings.npy"), p / "labels.npy"
    if labels.exists():
        if (n := np.load(labels, mmap_mode="r", allow_pickle=False).shape) != shape[:1]:
            raise ValueError(f"{n} labels for {shape[0]} vectors")
    elif require_labels:
        raise ValueError(f"no labels.npy in {folder}")

    def read(frames):
        import pandas as pd

        values = np.load(array, mmap_mode="r", allow_pickle=False)
        own = np.load(labels, mmap_mode="r", allow_pickle=False) if labels.exists() else None
        for pdf in frames:
            for start in pdf["start"]:
                end = min(start + rows_per_part, shape[0])
                out = pd.DataFrame({"row_id": np.arange(start, end), "embedding": list(np.asarray(values[start:end], dtype=np.float32))})
                out["label_idx"] = np.asarray(own[start:end], dtype=np.int64) if own is not None else None
                yield out

    parts = max(1, -(-shape[0] // rows_per_part))
    starts = spark.range(0, shape[0], rows_per_part, parts).select(F.col("id").alias("start")) if shape[0] else spark.range(0).select(F.col("id").alias("start"))
    vectors = starts.mapInPandas(read, "row_id bigint, embedding array<float>, label_idx bigint")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = read_ids(read_text(spark, [str(p / "ids.txt")]).select("pos", "line")).withColumn("_all", F.lit(0))
    ids = number_rows(lines.repartitionByRange(parts, "pos").sortWithinPartitions("pos"), "_all", "row_id").select("row_id", "id")
    if (found := ids.count()) != shape[0]:
        raise ValueError(f"{found} ids for {shape[0]} vectors")
    return vectors.join(ids, "row_id").select("row_id", "id", "embedding", "label_idx")


def resolve_store(spark: SparkSession, path: str | Path | None, make: Callable[[], DataFrame] | None = None, require_labels: bool = False) -> DataFrame:
    """The store at ``path`` if it is whole; else the one that ``make`` computes, kept at ``path`` if given.

    A folder that is neither empty nor a whole store is an error, as is having
    nothing to make a store from.
    """
    if path is not None:
        if is_populated(path):
            return read_store(spark, path, require_labels)[0]
        if paths.names(path):
            raise ValueError(f"{path} is not empty and no whole store")
    if make is None:
        raise ValueError("neither a store nor a way to make one")
    made = make()
    if path is None:
        check(made, None, require_labels)
        return made
    write_store(made, path)
    return read_store(spark, path, require_labels)[0]
