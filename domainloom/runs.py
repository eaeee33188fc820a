"""End-to-end runs: embed, build an index, annotate, evaluate, train."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AnnotateConfig, EmbedConfig, IndexConfig, TrainRunConfig
from .operators import annotate as ann
from .operators import metrics
from .operators.encode import EncodeConfig, Encoder, KmerEncoder, as_store, encode, with_labels
from .operators.project import Head, project
from .operators.skew import number_rows
from .operators.structure import attach_scores, structure_files
from .session import stage
from .sources import fasta, paths, sinks, store
from .sources.labels import label_table, label_vocabulary
from .train import Result, fit, split_rows


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, line`` of a label file, in file order."""
    return fasta.read_text(spark, [path]).select("pos", "line")


def encoded_store(spark: SparkSession, source: str, config: EncodeConfig, label_file: str | None = None, make_encoder=KmerEncoder) -> DataFrame:
    """A store from FASTA: first record of an id wins; with labels, rows without one are left out."""
    rows = encode(fasta.sequences(fasta.read_lines(spark, source)), make_encoder, config)
    if label_file is None:
        return as_store(rows)
    lines = label_lines(spark, label_file)
    labels = label_table(lines).join(label_vocabulary(lines), "label")
    kept, _ = with_labels(stage(rows), labels.select("id", "label_idx", F.col("label")))
    return as_store(kept.join(labels.select("id", "label_idx"), "id").drop("label"))


def run_embed(spark: SparkSession, config: EmbedConfig, make_encoder=KmerEncoder) -> str:
    made = encoded_store(spark, config.input, config.encode, config.label_file, make_encoder)
    vocabulary = None
    if config.label_file:
        # one row per class
        vocabulary = {r["label_idx"]: r["label"] for r in label_vocabulary(label_lines(spark, config.label_file)).collect()}
    return store.write_store(made, config.output_dir, source=config.input, vocabulary=vocabulary, overwrite=config.overwrite)


def run_build_index(spark: SparkSession, config: IndexConfig, make_encoder=KmerEncoder) -> DataFrame:
    """Writes the index and gives it back; the allow-list filters before anything is encoded or projected."""
    ids = fasta.header_ids(fasta.read_lines(spark, config.input))
    if config.ids:
        ids = fasta.allowed(ids, list(config.ids))

    def make() -> DataFrame:
        seqs = fasta.sequences(fasta.read_lines(spark, config.input))
        return as_store(encode(fasta.allowed(seqs, list(config.ids)) if config.ids else seqs, make_encoder, config.encode))

    rows = store.resolve_store(spark, config.store, make)
    found = rows.join(ids.select("id").distinct(), "id", "left_semi")
    if config.head:
        found = project(found, Head.load(config.head), batch_size=config.project_batch)
    else:
        found = found.withColumn("vec", F.col("embedding"))
    labels = label_table(label_lines(spark, config.label_file)) if config.label_file else None
    sinks.write_index(sinks.build_index(found.where(F.col("vec").isNotNull()), labels, half=config.dtype == "float16"), config.output)
    return sinks.read_index(spark, config.output)


def run_annotate(spark: SparkSession, config: AnnotateConfig, make_encoder=KmerEncoder) -> dict[str, str]:
    """Predictions of every FASTA file of the input as ``{stem}_annotations.tsv``, with metrics and curve where asked for.

    All files are annotated at once, so the index is read and sent once.  Reports
    are folders of parts in order, or single files with ``single_file``.
    """
    index = sinks.read_index(spark, config.index)
    labels = label_table(label_lines(spark, config.label_file)) if config.label_file else None
    head = Head.load(config.head) if config.head else None
    rows = store.resolve_store(spark, config.store, lambda: as_store(encode(fasta.sequences(fasta.read_lines(spark, config.input)), make_encoder, config.encode)))
    rows = stage(project(rows, head, batch_size=config.batch_size).select("row_id", "id", "vec") if head else rows.select("row_id", "id", F.col("embedding").alias("vec")))
    files = fasta.resolve_paths(config.input)
    heads = fasta.header_ids(fasta.read_text(spark, list(files.values())))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = heads.repartitionByRange(parts, "file", "pos").sortWithinPartitions("file", "pos").withColumn("_all", F.lit(0))
    ids = stage(number_rows(ordered, "_all", "query_pos").select("file", "query_pos", "id"))
    queries = ann.resolve(ids.drop("file"), rows).select("query_pos", F.col("id").alias("query_id"), "vec")
    has_labels = not index.where(F.col("label").isNotNull()).isEmpty()
    found = ann.annotate(queries, index if has_labels else index.drop("label"), config.k, config.distance_cutoff, labels, strategy=config.strategy)
    if config.return_true_annotation and labels is not None:
        found = ann.attach_truth(found, labels)
    if config.structure_dir:
        found = attach_scores(found, index, structure_files(spark, config.structure_dir), config.aligner)
    found = stage(ann.in_query_order(found.join(ids.select("query_pos", "file"), "query_pos"), "file"))
    has_truth = "true_annotation" in found.columns
    columns = sinks.prediction_columns(has_truth, config.return_distance, config.return_confidence, bool(config.structure_dir))
    out: dict[str, str] = {}
    for stem, path in files.items():
        own = found.where(F.col("file") == paths.qualified(path)).orderBy("position")
        out[stem] = paths.join(config.output_dir, f"{stem}_annotations.tsv")
        (sinks.write_tsv if config.single_file else sinks.write_tsv_parts)(own, out[stem], columns)
        if config.compute_metrics and has_truth:
            sinks.write_metrics(metrics.annotation_accuracy(own), paths.join(config.output_dir, f"{stem}_metrics.json"))
            sinks.write_tsv(metrics.selective_curve(own, config.num_thresholds).orderBy("threshold"), paths.join(config.output_dir, f"{stem}_selective_curve.tsv"))
    return out


def run_evaluate(spark: SparkSession, config: AnnotateConfig) -> dict:
    """1-NN accuracy of a labelled store against an index, and its summary."""
    rows, _ = store.read_store(spark, config.store)
    labels = label_table(label_lines(spark, config.label_file))
    head = Head.load(config.head) if config.head else None
    rows = project(rows, head) if head else rows.withColumn("vec", F.col("embedding"))
    queries = rows.join(labels, "id").select(F.col("row_id").alias("query_pos"), "vec", "label")
    return metrics.nearest_label_accuracy(queries, sinks.read_index(spark, config.index), strategy=config.strategy).first().asDict()


def run_train(spark: SparkSession, config: TrainRunConfig) -> Result:
    """Trains on the splits' rows of a labelled store; classes of a store without a vocabulary are named by their numbers."""
    rows, about = store.read_store(spark, config.store, require_labels=True)
    names = store.vocabulary_of(config.store, about)
    if names is None:
        # one row per class
        names = {r["label_idx"]: r["label"] for r in store.fallback_vocabulary(rows).collect()}

    def split(path: str) -> DataFrame:
        return split_rows(rows, fasta.header_ids(fasta.read_lines(spark, path)))

    tests = {stem: split(path) for stem, path in fasta.resolve_paths(config.test).items()} if config.test else {}
    result = fit(split(config.train), split(config.val), tests, config.fit, config.checkpoint_dir or config.output_dir)
    result.classes = names
    return result
