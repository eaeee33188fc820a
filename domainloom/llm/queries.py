"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import domain_of, split_of
from ..operators.knn import knn_join
from ..plans.scale import SQL_RECORDS, records_with_superfamily
from ..session import checkpoint_dir, stage, table
from ..sources.reports import parameters
from . import mpknn, neardup, overlap, packing, spam, splits, tokens
from .components import forest_edges
from .vectokens import usable


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, folder, "embedding_store").select("row_id", "embedding"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, folder, "embedding_store").select("row_id", "id", "embedding"))


def _split_records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "embedding_store").select(
        "row_id", domain_of(F.col("id")).alias("domain"), split_of(F.col("split")).alias("split"), "embedding", *columns
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(_split_records(spark, folder))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_split_records(spark, folder, "source"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other rows within distance 0.08 of every usable row of the index."""
    return mpknn.nearest(table(spark, folder, "vector_index").select("row_id", "vec")).select("row_id", "nn_row_id")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p4_found``, with distances and ranks."""
    near = mpknn.nearest(table(spark, folder, "vector_index").select("row_id", "vec"))
    return near.select("row_id", "nn_row_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other rows at any distance of every usable row of the index."""
    near = mpknn.nearest(table(spark, folder, "vector_index").select("row_id", "vec"), cutoff=None)
    return near.select("row_id", "nn_row_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its superfamily, component, delivered and newly assigned split."""
    now = parameters(table(spark, folder, "split_summary"))
    fractions = {s: now[f"{s}_fraction"] for s in ("train", "val", "test")}
    seed = int(now.get("random_seed", 0))
    records = records_with_superfamily(spark, folder, "split").select(
        "row_id", "domain", "superfamily", split_of(F.col("split")).alias("delivered")
    )
    return splits.assign_splits(records, ["superfamily", "domain"], fractions, seed=seed, forest_path=_forest_path(spark, folder))


def _forest_path(spark: SparkSession, folder: str) -> str:
    """Where the forest of a folder's tables is kept: in the shared folder, beyond the application that writes it."""
    return f"{checkpoint_dir(spark)}/domainloom/forest/{hashlib.sha256(folder.encode()).hexdigest()[:16]}"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.divided(p2_records(spark, folder), "superfamily").select(F.col("superfamily").alias("label_idx"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return p2_records(spark, folder).select("row_id", F.col("superfamily").alias("label_idx"), "root", "assigned")


def p2_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The spanning forest of superfamilies and domains, read from where the assignment of ``p2_splits`` keeps it."""
    p2_records(spark, folder)
    path = _forest_path(spark, folder)
    return forest_edges(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/forest"))


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per split: records assigned; whether their share is within a hundredth of the asked one; superfamilies and domains that another split has too."""
    rows = stage(p2_records(spark, folder).select("superfamily", "domain", "assigned"))
    now = parameters(table(spark, folder, "split_summary"))
    fractions = {s: now[f"{s}_fraction"] for s in ("train", "val", "test")}

    def torn(key: str) -> int:
        several = rows.where(F.col(key).isNotNull()).groupBy(key, "assigned").agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count("_one").alias("_n"))
        return several.where(F.col("_n") > 1).count()

    asked = F.element_at(F.create_map(*[F.lit(x) for s, f in fractions.items() for x in (s, f / sum(fractions.values()))]), F.col("assigned"))
    n, all_ = F.count(F.lit(1)), F.lit(rows.count())
    return rows.groupBy("assigned").agg(n.alias("_n")).select(
        "assigned", all_.alias("records_of_all_splits"), (F.abs(F.col("_n") / all_ - asked) <= 0.01).alias("share_kept"),
        F.lit(torn("superfamily")).alias("torn_superfamilies"), F.lit(torn("domain")).alias("torn_domains"),
    )


def _exact(spark: SparkSession, folder: str, strategy: str = "auto") -> DataFrame:
    """The 5 nearest of every row whose id is divisible by 100, against all usable rows, in blocks."""
    rows = table(spark, folder, "vector_index").select("row_id", "vec").where(usable(F.col("vec")))
    asked = rows.where(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_pos"), "vec")
    return knn_join(asked, rows, 5, exclude_self=True, strategy=strategy)


def p4_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other rows at any distance of every hundredth id."""
    return _exact(spark, folder).select(
        F.col("query_pos").alias("row_id"), F.col("db_row").alias("nn_row_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank")
    )


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One row: of the true nearest of every hundredth id, how many within 0.08 the hashing finds, and how many at any distance ``p4_nearest``.

    ``hashed`` and ``compared`` are the different vectors whose nearest at any
    distance came from the hashing, and from comparing them with all.
    """
    # in two phases, so that the driver does not hold the index a second time
    true = _exact(spark, folder, "two_phase").select(F.col("query_pos").alias("row_id"), F.col("db_row").alias("nn_row_id"), (F.col("distance") <= 0.08).alias("within"))
    found = p4_found(spark, folder).withColumn("hit", F.lit(1))
    steps: list[tuple[str, int]] = []
    full = mpknn.nearest(table(spark, folder, "vector_index").select("row_id", "vec"), cutoff=None, steps=steps).select("row_id", "nn_row_id", F.lit(1).alias("full_hit"))
    n, hit, every, full_hit = F.count_if("within"), F.count_if(F.col("within") & F.col("hit").isNotNull()), F.count(F.lit(1)), F.count("full_hit")
    share = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(1.0))
    return true.join(found, ["row_id", "nn_row_id"], "left").join(full, ["row_id", "nn_row_id"], "left").agg(
        n.alias("true_neighbours"), hit.alias("found"), share(hit, n).alias("recall"),
        every.alias("full_neighbours"), full_hit.alias("full_found"), share(full_hit, every).alias("full_recall"),
        F.lit(sum(n for _, n in steps[:-1])).alias("hashed"), F.lit(steps[-1][1]).alias("compared"),
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, tokens, and texts that decoding their ids does not give back (none)."""
    rows = table(spark, folder, "documents").select("source", "text", tokens.token_ids(F.col("text")).alias("ids"))
    back = rows.select("source", F.size("ids").alias("n"), (tokens.decoded(F.col("ids")) != F.coalesce("text", F.lit(""))).cast("bigint").alias("bad"))
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.sum("bad").alias("differing"))


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    # a fixed table of a few named capacities
    return {r[0]: r[1] for r in table(spark, folder, "pack_capacity").select("capacity_name", "capacity_tokens").collect()}


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), _capacities(spark, folder))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, folder), _capacities(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.assessed(table(spark, folder, "documents")).where("spam").select("doc_id")


def p8_assessed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its distance, direction and spam share."""
    return spam.assessed(table(spark, folder, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_splits": p2_splits, "p2_forest": p2_forest, "p2_check": p2_check,
        "p3_found": p3_found, "p3_report": p3_report,
        "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_nearest": p4_nearest, "p4_knn": p4_knn, "p4_recall": p4_recall,
        "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_packed": p7_packed, "p7_fill": p7_fill,
        "p8_found": p8_found, "p8_assessed": p8_assessed,
    }


def _unit_sql(source: str, column: str, keep: str) -> str:
    """Usable vectors of ``source`` as unit vectors in double precision; ``keep`` are further columns, each with a comma."""
    return f"""
usable AS (
  SELECT row_id, {keep} list_transform({column}, lambda x: CAST(x AS DOUBLE)) AS v FROM {source}
  WHERE len({column}) = 64 AND NOT list_bool_or(list_transform({column}, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform({column}, lambda x: x <> 0))),
unit AS (SELECT row_id, {keep} list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM usable)"""


_NEAREST_SQL = f"""
WITH {_unit_sql('vector_index', 'vec', '')},
near AS (SELECT a.row_id, b.row_id AS nn_row_id, 1 - list_inner_product(a.u, b.u) AS distance FROM unit a JOIN unit b ON a.row_id <> b.row_id WHERE list_inner_product(a.u, b.u) >= 0.92),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(distance, 10), nn_row_id) AS rank FROM near QUALIFY rank <= 5)
"""


def oracle_sql() -> dict[str, str]:
    """SQL over all pairs where it ends in seconds on the smaller tables; the rest is tested against brute force."""
    split = """
spelled AS (
  SELECT *, lower(regexp_replace(split, '[^A-Za-z]', '', 'g')) AS s FROM sf),
placed AS (
  SELECT * EXCLUDE s, CASE WHEN s IN ('train', 'training', 'trn') THEN 'train' WHEN s IN ('val', 'valid', 'validation', 'dev') THEN 'val'
    WHEN s IN ('test', 'testing', 'tst') THEN 'test' WHEN s IN ('holdout', 'holdouts') THEN 'holdout' END AS s FROM spelled)"""
    return {
        "p1_found": f"""
WITH {_unit_sql('embedding_store', 'embedding', '')}
SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM unit a JOIN unit b ON a.row_id < b.row_id WHERE list_inner_product(a.u, b.u) >= 0.97""",
        "p1_groups": f"""
WITH RECURSIVE {_unit_sql('embedding_store', 'embedding', '')},
near AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM unit a JOIN unit b ON a.row_id <> b.row_id WHERE list_inner_product(a.u, b.u) >= 0.97),
reach(row_id, other) AS (SELECT DISTINCT a, a FROM near UNION SELECT r.row_id, n.b FROM reach r JOIN near n ON r.other = n.a),
class AS (SELECT row_id, min(other) AS least FROM reach GROUP BY 1),
degree AS (SELECT a AS row_id, count(*) AS n FROM near GROUP BY 1)
SELECT s.row_id, s.id, coalesce(least, s.row_id) AS "group", coalesce(n, 0) AS links FROM embedding_store s LEFT JOIN class USING (row_id) LEFT JOIN degree USING (row_id)""",
        "p2_found": SQL_RECORDS + f""", {split}
SELECT superfamily AS label_idx FROM placed WHERE superfamily IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1""",
        "p2_check": """
SELECT s AS assigned, (SELECT count(*) FROM embedding_store) AS records_of_all_splits, TRUE AS share_kept, 0 AS torn_superfamilies, 0 AS torn_domains
FROM (VALUES ('train'), ('val'), ('test')) t(s)""",
        "p3_found": SQL_RECORDS + f""", {split}, {_unit_sql('placed', 'embedding', 's,')},
pairs AS (
  SELECT a.row_id AS e, b.row_id AS t FROM unit a JOIN unit b ON a.s <> 'train' AND b.s = 'train' WHERE list_inner_product(a.u, b.u) >= 0.97
  UNION SELECT a.row_id, b.row_id FROM placed a JOIN placed b ON a.domain = b.domain AND a.s <> 'train' AND b.s = 'train')
SELECT least(e, t) AS row_id_a, greatest(e, t) AS row_id_b FROM pairs""",
        "p3_report": SQL_RECORDS + f""", {split}, {_unit_sql('placed', 'embedding', 's, source,')},
close AS (SELECT a.row_id AS e, b.row_id AS t FROM unit a JOIN unit b ON a.s <> 'train' AND b.s = 'train' WHERE list_inner_product(a.u, b.u) >= 0.97),
close_rows AS (SELECT e AS row_id FROM close UNION SELECT t FROM close),
both_sides AS (SELECT domain FROM placed WHERE domain IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING bool_or(s = 'train') AND bool_or(s <> 'train')),
flagged AS (
  SELECT s AS split, source, row_id IN (SELECT row_id FROM close_rows) AS near, coalesce(domain IN (SELECT domain FROM both_sides), FALSE) AS same FROM placed WHERE s IS NOT NULL)
SELECT split, CASE WHEN split <> 'train' THEN source END AS source, count(*) AS records, count(*) FILTER (same) AS same_domain, count(*) FILTER (near) AS near,
       count(*) FILTER (same OR near) AS overlapping FROM flagged GROUP BY 1, 2""",
        "p4_found": _NEAREST_SQL + "SELECT row_id, nn_row_id FROM ranked",
        "p4_knn": f"""
WITH {_unit_sql('vector_index', 'vec', '')},
near AS (SELECT a.row_id, b.row_id AS nn_row_id, round(list_inner_product(a.u, b.u), 10) AS s FROM unit a JOIN unit b ON a.row_id <> b.row_id WHERE a.row_id % 100 = 0)
SELECT row_id, nn_row_id, round(1.0 - s, 6) AS distance, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, nn_row_id) AS rank FROM near QUALIFY rank <= 5""",
        "p4_nearest": f"""
WITH {_unit_sql('vector_index', 'vec', '')},
near AS (SELECT a.row_id, b.row_id AS nn_row_id, round(list_inner_product(a.u, b.u), 10) AS s FROM unit a JOIN unit b ON a.row_id <> b.row_id)
SELECT row_id, nn_row_id, round(1.0 - s, 6) AS distance, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, nn_row_id) AS rank FROM near QUALIFY rank <= 5""",
        "p4_neighbours": _NEAREST_SQL + "SELECT row_id, nn_row_id, round(distance, 6) AS distance, rank FROM ranked",
    }
