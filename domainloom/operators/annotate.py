"""k-NN annotation: neighbours to labels, cutoff, majority vote, confidence, truth and structural scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import knn_join
from .skew import number_rows

UNKNOWN = "unknown"
MISSING = "missing_embedding"


def resolve(ids: DataFrame, store: DataFrame) -> DataFrame:
    """``ids (query_pos, id)`` with ``row_id`` and the store's other columns; null where the store has no such id.

    One probe gives found and missing; order and duplicates of the queries are
    kept.  Of a repeated store id the last row counts.
    """
    last = store.groupBy("id").agg(F.max("row_id").alias("row_id"))
    rest = [c for c in store.columns if c not in ("id", "row_id")]
    rows = ids.join(last, "id", "left")
    return rows.join(store.select("row_id", *rest), "row_id", "left") if rest else rows


def decode(label: Column) -> Column:
    """The label, or ``unknown`` where it is absent."""
    return F.coalesce(label, F.lit(UNKNOWN))


def index_annotations(index: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``db_row, annotation``: an index row's own label where the index has labels, else its id's label in ``labels (id, label)``.

    A row that no label is found for has a null annotation and never votes; the
    literal label ``unknown`` of an index is a label like any other and may win.
    """
    if "label" in index.columns:
        return index.select(F.col("row_id").alias("db_row"), F.col("label").alias("annotation"))
    if labels is not None and "id" in index.columns:
        found = index.select("row_id", "id").join(labels.select("id", "label"), "id", "left")
        return found.select(F.col("row_id").alias("db_row"), F.col("label").alias("annotation"))
    return index.select(F.col("row_id").alias("db_row"), F.lit(None).cast("string").alias("annotation"))


def vote(neighbours: DataFrame, annotations: DataFrame, k: int, distance_cutoff: float) -> DataFrame:
    """``query_pos, predicted_annotation, distance, confidence, top1_db_row`` of every query with a neighbour.

    A neighbour beyond the cutoff (which is inclusive) does not vote; of equal
    counts the annotation that appears at the best rank wins; confidence is the
    winner's count over the requested ``k``.  If the nearest one is beyond the
    cutoff, or none votes, the prediction is ``unknown`` with confidence 0 and the
    nearest one's distance and row.
    """
    named = neighbours.join(annotations, "db_row", "left").withColumn(
        "annotation", F.when(F.col("distance") <= distance_cutoff, F.col("annotation"))
    )
    counts = named.groupBy("query_pos", "annotation").agg(
        F.count(F.lit(1)).alias("c"), F.min("rank").alias("r"), F.min(F.when(F.col("rank") == 1, F.struct("distance", "db_row"))).alias("top")
    )
    valid = F.col("annotation").isNotNull()
    won = counts.groupBy("query_pos").agg(
        F.max_by(F.when(valid, F.col("annotation")), F.when(valid, F.struct("c", -F.col("r")))).alias("winner"),
        F.max(F.when(valid, F.col("c"))).alias("votes"), F.max("top").alias("top"),
    )
    passes = (F.col("top.distance") <= distance_cutoff) & F.col("winner").isNotNull()
    return won.select(
        "query_pos", F.when(passes, F.col("winner")).otherwise(UNKNOWN).alias("predicted_annotation"), F.col("top.distance").alias("distance"),
        F.when(passes, F.col("votes") / F.lit(float(k))).otherwise(F.lit(0.0)).alias("confidence"), F.col("top.db_row").alias("top1_db_row"),
    )


def annotate(queries: DataFrame, index: DataFrame, k: int, distance_cutoff: float = 1.0, labels: DataFrame | None = None, exclude_self: bool = False, strategy: str = "auto") -> DataFrame:
    """Predictions for ``queries (query_pos, query_id, vec)``, one row each.

    A query without a vector is ``missing_embedding`` with null distance and
    confidence and row -1; with an empty index every other query is ``unknown``
    with null distance and confidence 0.
    """
    neighbours = knn_join(queries.select("query_pos", "vec"), index.select("row_id", "vec"), k, exclude_self, strategy)
    votes = vote(neighbours, index_annotations(index, labels), k, distance_cutoff)
    missing = F.col("vec").isNull()
    return queries.join(votes, "query_pos", "left").select(
        "query_pos", "query_id", F.when(missing, MISSING).otherwise(decode(F.col("predicted_annotation"))).alias("predicted_annotation"),
        "distance", F.when(~missing, F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.coalesce("top1_db_row", F.lit(-1)).cast("bigint").alias("top1_db_row"),
    )


def attach_truth(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """``true_annotation`` from ``labels (id, label)`` by query id; ``unknown`` where there is none."""
    truth = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_truth"))
    return predictions.drop("true_annotation").join(truth, "query_id", "left").withColumn("true_annotation", decode(F.col("_truth"))).drop("_truth")


def in_query_order(predictions: DataFrame, by: str | None = None) -> DataFrame:
    """``position``: rows sorted at the last place of their query id, then by their own place; with ``by``, within each of its values.

    Output order of the reports: repeated ids stand together.  Positions are
    dense; they are assigned range by range, so no task sorts all rows.
    """
    group = [by] if by else []
    last = predictions.groupBy(F.col("query_id").alias("_id"), *[F.col(c).alias("_by") for c in group]).agg(F.max("query_pos").alias("_last"))
    same = F.col("query_id").eqNullSafe(F.col("_id"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col("_by"))
    joined = predictions.join(last, same).drop("_id", "_by")
    parts = max(1, int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = joined.repartitionByRange(parts, *group, "_last", "query_pos").sortWithinPartitions(*group, "_last", "query_pos")
    return number_rows(ordered.withColumn("_all", F.col(by) if by else F.lit(0)), "_all", "position").drop("_all", "_last")


def index_labels(index: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id, id, label``: each index id's label, ``unknown`` where it has none."""
    named = index.select("row_id", "id").join(labels.select("id", "label"), "id", "left")
    return named.select("row_id", "id", decode(F.col("label")).alias("label"))


def top_hits(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """``query_pos, query_id, target_id`` of the annotated predictions with a nearest row."""
    hit = predictions.where(~F.col("predicted_annotation").isin(UNKNOWN, MISSING) & (F.col("top1_db_row") >= 0))
    return hit.join(index.select(F.col("row_id").alias("top1_db_row"), F.col("id").alias("target_id")), "top1_db_row").select("query_pos", "query_id", "target_id")
