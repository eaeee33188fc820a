"""Queries of the core's own large-scale problem: per-superfamily results under skew (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import number_rows, superfamily_profiles
from ..session import table
from ..sources.labels import with_superfamily
from ..sources.reports import parameter


def records_with_superfamily(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``embedding_store`` rows with ``domain`` and ``superfamily`` and the named columns."""
    store = table(spark, folder, "embedding_store").select("row_id", "id", "label_idx", *columns)
    return with_superfamily(store, table(spark, folder, "label_text"), table(spark, folder, "label_vocab"))


def p5_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return superfamily_profiles(records_with_superfamily(spark, folder, "source", "embedding"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """``label_idx`` of every superfamily with more records than the ``max_sf_size`` in force."""
    most = parameter(table(spark, folder, "split_summary"), "max_sf_size")
    return p5_profiles(spark, folder).where(F.col("records") > most).select(F.col("superfamily").alias("label_idx"))


def p5_superfamilies(spark: SparkSession, folder: str) -> DataFrame:
    """Per superfamily: records, usable vectors, sources, and the first and last component of the mean vector."""
    return p5_profiles(spark, folder).select(
        F.col("superfamily").alias("label_idx"), "records", "usable", "sources",
        F.round(F.get("mean", F.lit(0)), 6).alias("mean_first"), F.round(F.get("mean", F.lit(63)), 6).alias("mean_last"),
    )


def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows numbered in ``row_id`` order within nullable keys of 60 bits, beside a nullable value of 60 bits."""
    wide = lambda c: F.lit(2**60) + F.col(c)
    rows = table(spark, folder, "embedding_store").select("row_id", wide("label_idx").alias("wide_key"), F.when(F.col("row_id") % 3 != 0, wide("row_id")).alias("wide_value"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return number_rows(rows.repartitionByRange(parts, "row_id").sortWithinPartitions("row_id"), "wide_key", "place")


#: SQL of a record's domain and superfamily, shared by the queries that need it.
SQL_RECORDS = r"""
WITH tok AS (
  SELECT row_id, id, label_idx, split, source, embedding,
         nullif(regexp_extract(regexp_replace(regexp_replace(id, '^\s+|\s+$', '', 'g'), '^>', ''), '(\S+)', 1), '') AS t
  FROM embedding_store),
cut AS (
  SELECT *, CASE WHEN len(string_split(t, '|')) >= 3 THEN string_split(t, '|')[3] ELSE t END AS u FROM tok),
dom AS (
  SELECT *, string_split(u, '/')[1] AS v FROM cut),
rec AS (
  SELECT row_id, id, label_idx, split, source, embedding,
    CASE WHEN v = '' THEN NULL WHEN starts_with(v, 'AF-') THEN regexp_replace(v, 'model_v[0-9]+', 'model_v', 'g')
         WHEN regexp_full_match(v, '[0-9][A-Za-z0-9]{3}[A-Za-z0-9][0-9]{2}') THEN lower(substr(v, 1, 4)) || substr(v, 5, 3)
         ELSE v END AS domain FROM dom),
lines AS (
  SELECT pos, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM label_text
  WHERE line IS NOT NULL AND NOT starts_with(line, '#')),
ltok AS (
  SELECT pos, regexp_replace(w[1], '^>', '') AS t, w[2] AS label FROM lines WHERE len(w) >= 2),
lcut AS (
  SELECT pos, label, string_split(CASE WHEN len(string_split(t, '|')) >= 3 THEN string_split(t, '|')[3] ELSE t END, '/')[1] AS v FROM ltok),
ldom AS (
  SELECT pos, label, CASE WHEN v = '' THEN NULL WHEN starts_with(v, 'AF-') THEN regexp_replace(v, 'model_v[0-9]+', 'model_v', 'g')
         WHEN regexp_full_match(v, '[0-9][A-Za-z0-9]{3}[A-Za-z0-9][0-9]{2}') THEN lower(substr(v, 1, 4)) || substr(v, 5, 3)
         ELSE v END AS domain FROM lcut),
last AS (
  SELECT domain, arg_max(label, pos) AS label FROM ldom WHERE domain IS NOT NULL GROUP BY domain),
sf AS (
  SELECT r.*, coalesce(r.label_idx, w.label_idx) AS superfamily
  FROM rec r LEFT JOIN last l ON r.domain = l.domain LEFT JOIN label_vocab w ON w.label = l.label)
"""

#: SQL of the parameters in force.
SQL_PARAMETERS = r"""
, latest AS (SELECT run_id FROM split_summary ORDER BY run_at DESC, run_id DESC LIMIT 1),
params AS (
  SELECT trim(item) AS item, max(try_cast(regexp_replace(val, '[\s,_'']', '', 'g') AS DOUBLE)) AS value
  FROM split_summary WHERE run_id = (SELECT run_id FROM latest) AND trim(section) = 'params' GROUP BY 1)
"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_superfamilies": p5_superfamilies, "numbered_rows": numbered_rows}


def oracle_sql() -> dict[str, str]:
    return {
        "numbered_rows": """
SELECT row_id, 1152921504606846976 + label_idx AS wide_key, CASE WHEN row_id % 3 <> 0 THEN 1152921504606846976 + row_id END AS wide_value,
       row_number() OVER (PARTITION BY label_idx ORDER BY row_id) - 1 AS place FROM embedding_store""",
        "p5_found": SQL_RECORDS + SQL_PARAMETERS + """
SELECT superfamily AS label_idx FROM sf WHERE superfamily IS NOT NULL GROUP BY 1
HAVING count(*) > (SELECT value FROM params WHERE item = 'max_sf_size')""",
        "p5_superfamilies": SQL_RECORDS + """
, ok AS (
  SELECT superfamily, source,
    CASE WHEN len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding END AS v
  FROM sf WHERE superfamily IS NOT NULL)
SELECT superfamily AS label_idx, count(*) AS records, count(v) AS usable, count(DISTINCT source) AS sources,
       round(avg(CAST(v[1] AS DOUBLE)), 6) AS mean_first, round(avg(CAST(v[64] AS DOUBLE)), 6) AS mean_last
FROM ok GROUP BY 1""",
    }
