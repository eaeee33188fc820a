"""One object with the public operations, for interactive use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import train as training
from .operators import annotate as ann
from .operators import encode as enc
from .operators import knn, losses, metrics, skew, structure
from .operators import project as proj
from .sources import fasta, labels, sinks, store


class Engine:
    """Bundles a session with readers, operators and sinks."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def read_fasta(self, source: str) -> DataFrame:
        return fasta.sequences(fasta.read_lines(self.spark, source))

    def read_labels(self, path: str) -> DataFrame:
        return labels.label_table(fasta.read_text(self.spark, [path]))

    def read_store(self, path: str, require_labels: bool = False) -> DataFrame:
        return store.read_store(self.spark, path, require_labels)[0]

    def read_index(self, path: str) -> DataFrame:
        return sinks.read_index(self.spark, path)

    def import_arrays(self, folder: str, require_labels: bool = False) -> DataFrame:
        return store.import_arrays(self.spark, folder, require_labels=require_labels)

    def resolve_store(self, path: str | None, make=None, require_labels: bool = False) -> DataFrame:
        return store.resolve_store(self.spark, path, make, require_labels)

    def learning_rates(self, epochs: int, base: float, warmup: int = 10, least: float = 1e-6) -> DataFrame:
        return losses.learning_rates(self.spark, epochs, base, warmup, least)

    encode = staticmethod(enc.encode)
    encode_all = staticmethod(enc.encode_all)
    encoder_batches = staticmethod(enc.encoder_batches)
    as_store = staticmethod(enc.as_store)
    write_store = staticmethod(store.write_store)
    project = staticmethod(proj.project)
    build_index = staticmethod(sinks.build_index)
    write_index = staticmethod(sinks.write_index)
    search = staticmethod(knn.knn_join)
    padded = staticmethod(knn.padded)
    resolve = staticmethod(ann.resolve)
    gather = staticmethod(store.gather)
    annotate = staticmethod(ann.annotate)
    attach_truth = staticmethod(ann.attach_truth)
    in_query_order = staticmethod(ann.in_query_order)
    write_report = staticmethod(sinks.write_tsv)
    write_report_parts = staticmethod(sinks.write_tsv_parts)
    summarize = staticmethod(metrics.summarize)
    confidences = staticmethod(metrics.confidences)
    accuracy = staticmethod(metrics.annotation_accuracy)
    selective_curve = staticmethod(metrics.selective_curve)
    nearest_label_accuracy = staticmethod(metrics.nearest_label_accuracy)
    supcon_loss = staticmethod(losses.supcon_loss)
    proxy_anchor_loss = staticmethod(losses.proxy_anchor_loss)
    attach_scores = staticmethod(structure.attach_scores)
    number_rows = staticmethod(skew.number_rows)
    profiles = staticmethod(skew.superfamily_profiles)
    train = staticmethod(training.fit)
