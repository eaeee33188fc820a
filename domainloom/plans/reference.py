"""Queries of the annotation engine's operators, each with its SQL, over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runs, train
from ..config import AnnotateConfig, EmbedConfig, IndexConfig
from ..functions.ids import split_of
from ..operators import annotate as ann
from ..operators import encode, knn, losses, metrics, project, structure, vectors
from ..session import shared_path, stage, table
from ..sources import fasta, labels, paths, sinks, store
from ..sources.reports import parameters
from .scale import SQL_PARAMETERS, SQL_RECORDS, records_with_superfamily

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- shared SQL ---------------------------------------------------------------------------------------------------

#: Id of a header held in column h.
_TOKEN = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(h, '^\s+', ''), '^>', ''), '(\S+)', 1), '^[^|]*\|[^|]*\|([^|]*).*$', '\1'), '/.*$', '')"

SQL_SEQUENCES = rf"""
WITH kept AS (SELECT file, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS h FROM fasta_text WHERE line IS NOT NULL),
marked AS (SELECT *, max(CASE WHEN starts_with(h, '>') THEN pos END) OVER (PARTITION BY file ORDER BY pos) AS start FROM kept WHERE h <> ''),
records AS (
  SELECT file, start AS pos, max(CASE WHEN starts_with(h, '>') THEN {_TOKEN} END) AS id,
         replace(coalesce(string_agg(CASE WHEN NOT starts_with(h, '>') THEN h END, '' ORDER BY pos), ''), '-', '') AS sequence
  FROM marked WHERE start IS NOT NULL GROUP BY file, start),
seqs AS (
  SELECT file, pos, id, sequence, CAST(length(sequence) AS INTEGER) AS length FROM records WHERE id <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY file, pos) = 1)
"""

SQL_LABELS = r"""
WITH toks AS (SELECT pos, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM label_text
              WHERE line IS NOT NULL AND NOT starts_with(line, '#')),
parsed AS (SELECT pos, w[1] AS id, w[2] AS label FROM toks WHERE len(w) >= 2),
lab AS (SELECT id, arg_max(label, pos) AS label FROM parsed GROUP BY id)
"""

#: Unit vectors of ``embeddings``, scaled first so that the normalization has something to do, and all their neighbours.
SQL_UNIT = """
WITH raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS v FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u FROM raw)
"""


def _neighbours_sql(k: int, where: str = "q.vec_id <> d.vec_id", query_where: str = "TRUE") -> str:
    return SQL_UNIT + f"""
, pairs AS (SELECT q.vec_id AS query_pos, d.vec_id AS db_row, d.label, round(list_inner_product(q.u, d.u), 10) AS similarity
            FROM unit q JOIN unit d ON {where} WHERE {query_where}),
nn AS (SELECT *, 1.0 - similarity AS distance, row_number() OVER (PARTITION BY query_pos ORDER BY similarity DESC, db_row) AS rank
       FROM pairs QUALIFY rank <= {k})
"""


def _vote_sql(k: int, cutoff: float, annotation: str) -> str:
    return f"""
, named AS (SELECT *, CASE WHEN distance <= {cutoff} THEN {annotation} END AS annotation FROM nn),
counted AS (SELECT query_pos, annotation, count(*) AS c, min(rank) AS r FROM named WHERE annotation IS NOT NULL GROUP BY 1, 2),
won AS (SELECT query_pos, arg_max(annotation, (c, -r)) AS winner, max(c) AS votes FROM counted GROUP BY 1),
top AS (SELECT query_pos, distance, db_row FROM nn WHERE rank = 1),
voted AS (
  SELECT t.query_pos, CASE WHEN t.distance <= {cutoff} AND winner IS NOT NULL THEN winner ELSE 'unknown' END AS predicted_annotation, t.distance,
         CASE WHEN t.distance <= {cutoff} AND winner IS NOT NULL THEN votes / {float(k)} ELSE 0.0 END AS confidence, t.db_row AS top1_db_row
  FROM top t LEFT JOIN won w USING (query_pos))
"""


_VOTED = "SELECT query_pos, predicted_annotation, round(distance, 6) AS distance, round(confidence, 6) AS confidence, top1_db_row FROM voted"


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, label, vec``: vectors scaled by 1 to 3, so that normalization is exercised."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    return table(spark, folder, "embeddings").select("vec_id", "label", v.alias("vec"))


def _queries(e: DataFrame) -> DataFrame:
    return e.select(F.col("vec_id").alias("query_pos"), F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("query_id"), "vec")


def _index(e: DataFrame) -> DataFrame:
    return e.select(F.col("vec_id").alias("row_id"), F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), "vec")


def _voted(df: DataFrame) -> DataFrame:
    return df.select("query_pos", "predicted_annotation", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"), "top1_db_row")


# ---- sources ------------------------------------------------------------------------------------------------------


@query(rf"SELECT file, pos, {_TOKEN} AS id FROM (SELECT file, pos, line AS h FROM fasta_text) WHERE starts_with(h, '>') AND {_TOKEN} <> ''")
def fasta_header_parse(spark: SparkSession, folder: str) -> DataFrame:
    return fasta.header_ids(table(spark, folder, "fasta_text"))


@query(SQL_SEQUENCES + "SELECT file, pos, id, sequence, length FROM seqs")
def fasta_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return fasta.sequences(table(spark, folder, "fasta_text"))


@query(SQL_SEQUENCES + "SELECT file, pos, id, CAST(length(sequence) AS INTEGER) AS length FROM records WHERE id <> ''")
def fasta_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record, repeated ids included."""
    return fasta.sequences(table(spark, folder, "fasta_text"), first_wins=False).drop("sequence")


@query(SQL_SEQUENCES + "SELECT file, count(*) AS sequences, CAST(sum(length) AS BIGINT) AS residues FROM seqs GROUP BY 1")
def residue_totals(spark: SparkSession, folder: str) -> DataFrame:
    return encode.residue_totals(fasta.sequences(table(spark, folder, "fasta_text")))


@query(SQL_LABELS + "SELECT id, label FROM lab")
def label_table(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_table(table(spark, folder, "label_text"))


@query(SQL_LABELS + "SELECT label, row_number() OVER (ORDER BY min(pos)) - 1 AS label_idx FROM parsed GROUP BY label")
def label_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_vocabulary(table(spark, folder, "label_text"))


@query(r"SELECT pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS id FROM label_text WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''")
def id_lines(spark: SparkSession, folder: str) -> DataFrame:
    return store.read_ids(table(spark, folder, "label_text"))


@query("SELECT id, max(row_id) AS row_id FROM embedding_store WHERE id IS NOT NULL GROUP BY id")
def id_to_row(spark: SparkSession, folder: str) -> DataFrame:
    return store.last_rows(table(spark, folder, "embedding_store"))


_ALIAS = "CASE label_idx % 3 WHEN 0 THEN 'dims' WHEN 1 THEN 'dim' ELSE 'embedding_dim' END"


@query(f"""
WITH j AS (SELECT label_idx, '{{"' || {_ALIAS} || '": ' || label_idx || ', "count": 3}}' AS raw FROM label_vocab)
SELECT label_idx, CAST(coalesce(json_extract_string(raw, '$.dims'), json_extract_string(raw, '$.dim'), json_extract_string(raw, '$.embedding_dim')) AS BIGINT) AS dim,
       CAST(json_extract_string(raw, '$.count') AS BIGINT) AS n FROM j""")
def metadata_alias(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "label_vocab").selectExpr("label_idx", f"""concat('{{"', {_ALIAS}, '": ', label_idx, ', "count": 3}}') AS raw""")
    return raw.select("label_idx", store.metadata_column(F.col("raw"), "dim").cast("bigint").alias("dim"), store.metadata_column(F.col("raw"), "count").cast("bigint").alias("n"))


@query("SELECT label_idx, label FROM label_vocab")
def idx_to_label(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "label_vocab").selectExpr("""concat('{"idx_to_label": {"', label_idx, '": "', label, '"}}') AS raw""")
    return raw.select(F.explode(store.label_map(F.col("raw"))).alias("e")).select(F.col("e.key").cast("bigint").alias("label_idx"), F.col("e.value").alias("label"))


@query("""
WITH f AS (SELECT 'd' || doc_id AS id, doc_id AS n FROM documents),
files AS (
  SELECT id, '.cif.gz' AS ext FROM f WHERE n % 2 = 0 UNION ALL SELECT id, '.pdb' FROM f WHERE n % 3 = 0
  UNION ALL SELECT id, '.ent.gz' FROM f WHERE n % 5 = 0 UNION ALL SELECT id, '.txt' FROM f WHERE n % 7 = 0)
SELECT id, arg_min(id || ext, list_position(['.pdb', '.cif', '.pdb.gz', '.cif.gz', '.ent', '.ent.gz'], ext)) AS path
FROM files WHERE ext <> '.txt' GROUP BY id""")
def structure_resolve(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("n"))
    kinds = F.array(*[F.when(F.col("n") % m == 0, F.lit(ext)) for m, ext in ((2, ".cif.gz"), (3, ".pdb"), (5, ".ent.gz"), (7, ".txt"))])
    files = f.select("id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("ext")).withColumn("path", F.concat("id", "ext"))
    return structure.preferred(files)


# ---- projections and filters --------------------------------------------------------------------------------------


@query(SQL_SEQUENCES + """
SELECT id, '<AA2fold>' || CASE WHEN sequence = '' THEN ' ' ELSE ' ' || array_to_string(string_split(translate(sequence, 'UZO', 'XXX'), ''), ' ') END AS formatted FROM seqs""")
def sequence_format(spark: SparkSession, folder: str) -> DataFrame:
    return fasta.sequences(table(spark, folder, "fasta_text")).select("id", encode.tokenizable(F.col("sequence")).alias("formatted"))


@query("""
WITH n AS (SELECT row_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vector_index WHERE vec IS NOT NULL),
m AS (SELECT row_id, v, sqrt(list_inner_product(v, v)) AS len FROM n)
SELECT row_id, round(len, 6) AS norm, round(v[1] / greatest(len, 1e-12), 6) AS first_value, round(v[64] / greatest(len, 1e-12), 6) AS last_value FROM m""")
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "vector_index").where(F.col("vec").isNotNull())
    u = rows.select("row_id", vectors.norm(F.col("vec")).alias("norm"), vectors.l2_normalize(F.col("vec")).alias("u"))
    return u.select("row_id", F.round("norm", 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first_value"), F.round(F.get("u", F.lit(63)), 6).alias("last_value"))


@query("""
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round((v[17] + v[33] + v[49]) / 3, 6) AS first_value, round((v[32] + v[48] + v[64]) / 3, 6) AS last_value FROM t""")
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors read as four tokens of 16 values, the first of them a prefix."""
    v = table(spark, folder, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("v"))
    tokens = F.array(*[F.slice("v", 1 + 16 * i, 16) for i in range(4)])
    pooled = v.select("vec_id", vectors.mean_pool(tokens, F.lit(3)).alias("p"))
    return pooled.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("first_value"), F.round(F.get("p", F.lit(15)), 6).alias("last_value"))


_REPORT = (
    "'Length of Chain_1: ' || (query_pos % 400) || ' residues\nLength of Chain_2: 77 residues\n' || CASE WHEN query_pos % 11 = 0 THEN 'failed' WHEN query_pos % 13 = 0"
    " THEN 'Aligned length= 5\nRMSD=   1.5\nTM-score= 0.9 (if normalized by length of Chain_1)' ELSE 'Aligned length= ' || (query_pos % 300)"
    " || ', RMSD=   ' || (query_pos % 9) || '.5, Seq_ID=0.1\nTM-score= 0.01 (if normalized by length of Chain_2)\nTM-score= 0.' || (10 + query_pos % 90) || ' (if normalized by length of Chain_1)' END"
)


@query(f"""
WITH r AS (SELECT query_pos, {_REPORT} AS t FROM annotations),
p AS (SELECT query_pos, nullif(regexp_extract(t, 'Aligned length=\\s*(\\d+),\\s*RMSD=', 1), '') AS a, nullif(regexp_extract(t, 'Aligned length=\\s*\\d+,\\s*RMSD=\\s*([\\d.]+)', 1), '') AS r,
             nullif(regexp_extract(t, 'Length of Chain_1:\\s*(\\d+)\\s*residues', 1), '') AS l, nullif(regexp_extract(t, 'TM-score=\\s*([\\d.]+)\\s*\\(if normalized by length of Chain_1', 1), '') AS s FROM r)
SELECT query_pos, CASE WHEN a IS NOT NULL THEN CAST(s AS DOUBLE) END AS tm_score, CASE WHEN a IS NOT NULL THEN CAST(r AS DOUBLE) END AS rmsd,
       CASE WHEN a IS NULL THEN NULL WHEN CAST(l AS INTEGER) > 0 THEN round(CAST(a AS INTEGER) / CAST(l AS INTEGER), 6) ELSE 0.0 END AS tm_coverage FROM p""")
def tm_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = table(spark, folder, "annotations").selectExpr("query_pos", _REPORT.replace("\n", "\\n") + " AS t")
    parts = structure.parse_report(F.col("t"))
    return text.select("query_pos", parts["tm_score"].alias("tm_score"), parts["rmsd"].alias("rmsd"), F.round(parts["coverage"], 6).alias("tm_coverage"))


@query("SELECT e AS epoch, round(CASE WHEN e < 10 THEN 0.003 * (0.01 + 0.99 * e / 10) ELSE 1e-6 + (0.003 - 1e-6) * (1 + cos(pi() * (e - 10) / 190)) / 2 END, 9) AS learning_rate FROM (SELECT unnest(range(200)) AS e)")
def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return losses.learning_rates(spark, 200, 0.003).select("epoch", F.round("learning_rate", 9).alias("learning_rate"))


def _small_head() -> project.Head:
    """A head of 64, 3 and 2 values with weights by rule."""
    rule = lambda n, m, a, b: np.array([[((i * a + j * b) % 11 - 5) / 20 for j in range(m)] for i in range(n)])
    row = lambda n, a: rule(1, n, 1, a)[0]
    return project.Head(rule(3, 64, 7, 3), row(3, 4), 1 + row(3, 5), row(3, 2), row(3, 3), 1 + np.abs(row(3, 6)), rule(2, 3, 5, 8), row(2, 9))


def _head_sql(head: project.Head) -> str:
    """``row_id, y0, y1, len``: the head's output before its normalization, and its length, of the rows of ``good (row_id, v)``."""
    scale = head.gamma / np.sqrt(head.var + project.BN_EPS)
    hidden = ", ".join(f"list_inner_product(v, {(head.w1[h] * scale[h]).tolist()}) + {float((head.b1[h] - head.mean[h]) * scale[h] + head.beta[h])!r} AS h{h}" for h in range(3))
    # the error function by formula 7.1.26 of Abramowitz and Stegun
    t = lambda x: f"(1 / (1 + 0.3275911 * abs({x})))"
    erf = lambda x: f"(sign({x}) * (1 - {t(x)} * (0.254829592 + {t(x)} * (-0.284496736 + {t(x)} * (1.421413741 + {t(x)} * (-1.453152027 + {t(x)} * 1.061405429)))) * exp(-({x}) * ({x}))))"
    gelu = ", ".join(f"0.5 * h{h} * (1 + {erf(f'(h{h} / sqrt(2))')}) AS g{h}" for h in range(3))
    out = ", ".join(" + ".join([repr(float(head.b2[o])), *[f"g{h} * ({float(head.w2[o][h])!r})" for h in range(3)]]) + f" AS y{o}" for o in range(2))
    return f"""hid AS (SELECT row_id, {hidden} FROM good), act AS (SELECT row_id, {gelu} FROM hid), res AS (SELECT row_id, {out} FROM act),
projected AS (SELECT row_id, y0, y1, greatest(sqrt(y0 * y0 + y1 * y1), 1e-12) AS len FROM res)"""


@query(f"""
WITH good AS (
  SELECT row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embedding_store
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))),
{_head_sql(_small_head())}
SELECT s.row_id, round(y0 / len, 2) AS first_value, round(y1 / len, 2) AS second_value FROM embedding_store s LEFT JOIN projected USING (row_id)""")
def project_head(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector through a head that is written and read back; vectors that do not fit are null."""
    at = shared_path(spark, "head.npz")
    _small_head().save(at)
    rows = project.project(table(spark, folder, "embedding_store").select("row_id", "embedding"), project.Head.load(at))
    return rows.select("row_id", *[F.round(F.get("vec", F.lit(i)).cast("double"), 2).alias(n) for i, n in enumerate(("first_value", "second_value"))])


@query(SQL_SEQUENCES + """
SELECT row_number() OVER (ORDER BY file, pos) - 1 AS row_id, id, CAST(floor(1000.0 * (length(s) - length(replace(s, 'A', ''))) / length(s) + 0.3217) AS BIGINT) AS alanine, CAST(floor(1000.0 * (length(s) - length(replace(s, 'X', ''))) / length(s) + 0.3217) AS BIGINT) AS masked
FROM (SELECT file, pos, id, translate(sequence, 'UZO', 'XXX') AS s FROM seqs) WHERE s <> ''""")
def composition_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence through an encoder of residue shares, as a store in the order of the input."""
    seqs = fasta.sequences(table(spark, folder, "fasta_text"))
    rows = encode.as_store(encode.encode(seqs, encode.CompositionEncoder, encode.EncodeConfig(dtype="float32")))
    # thousandths, cut where no share of a short sequence lies
    at = lambda letter: F.floor(1000 * F.get("embedding", F.lit(encode.RESIDUES.index(letter))).cast("double") + 0.3217)
    return rows.select("row_id", "id", at("A").alias("alanine"), at("X").alias("masked"))


@query()
def kmer_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence through the deterministic encoder, as a store."""
    seqs = fasta.sequences(table(spark, folder, "fasta_text"))
    return encode.as_store(encode.encode(seqs, encode.KmerEncoder)).select("row_id", "id", F.round(vectors.norm(F.col("embedding")), 3).alias("norm"))


@query()
def train_head(spark: SparkSession, folder: str) -> DataFrame:
    """Two epochs over four fifths of the vectors, evaluated on the rest."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").cast("bigint").alias("label_idx")
    )
    config = train.TrainConfig(hidden_dim=32, output_dim=16, max_epochs=2, warmup_epochs=1, batch_size=256)
    result = train.fit(rows.where(F.col("row_id") % 5 != 0), rows.where(F.col("row_id") % 5 == 0), config=config)
    history = [(h["epoch"], h["train_loss"], h["val_loss"], h["val_accuracy"]) for h in result.history]
    return spark.createDataFrame(history, "epoch bigint, train_loss double, val_loss double, val_accuracy double")


@query()
def train_head_store(spark: SparkSession, folder: str) -> DataFrame:
    """A run with the default configuration over the labelled usable vectors of the store: rows of train, evaluated on those of val."""
    v = F.col("embedding")
    whole = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = stage(table(spark, folder, "embedding_store").where(F.coalesce(whole, F.lit(False)) & F.col("label_idx").isNotNull()).select("row_id", "id", "embedding", "label_idx", split_of(F.col("split")).alias("_s")))
    result = train.fit(rows.where("_s = 'train'").drop("_s"), rows.where("_s = 'val'").drop("_s"))
    history = [(h["epoch"], h["train_loss"], h["val_loss"], h["val_accuracy"]) for h in result.history]
    return spark.createDataFrame(history, "epoch bigint, train_loss double, val_loss double, val_accuracy double")


# ---- joins --------------------------------------------------------------------------------------------------------


@query(SQL_LABELS + """
SELECT p.pos AS query_pos, p.id, s.row_id FROM parsed p LEFT JOIN (SELECT id, max(row_id) AS row_id FROM embedding_store GROUP BY id) s ON p.id = s.id""")
def resolve_found_missing(spark: SparkSession, folder: str) -> DataFrame:
    ids = labels.parse_label_lines(table(spark, folder, "label_text")).select(F.col("pos").alias("query_pos"), "id")
    return ann.resolve(ids, table(spark, folder, "embedding_store").select("row_id", "id")).select("query_pos", "id", "row_id")


@query(SQL_LABELS + """
, last AS (SELECT id, max(row_id) AS row_id FROM embedding_store GROUP BY id)
SELECT p.pos AS query_pos, p.id, CAST(len(s.embedding) AS INTEGER) AS dim, round(CAST(s.embedding[1] AS DOUBLE), 5) AS first_value
FROM parsed p JOIN last l ON p.id = l.id JOIN embedding_store s ON s.row_id = l.row_id""")
def gather_batch(spark: SparkSession, folder: str) -> DataFrame:
    ids = labels.parse_label_lines(table(spark, folder, "label_text")).select(F.col("pos").alias("query_pos"), "id")
    rows = store.gather(ids, table(spark, folder, "embedding_store").select("row_id", "id", "embedding"))
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return rows.select("query_pos", "id", size.alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"))


@query(SQL_LABELS + "SELECT row_id, v.id, coalesce(l.label, 'unknown') AS label FROM vector_index v LEFT JOIN lab l ON v.id = l.id")
def build_index_labels(spark: SparkSession, folder: str) -> DataFrame:
    return ann.index_labels(table(spark, folder, "vector_index"), labels.label_table(table(spark, folder, "label_text")))


@query(SQL_LABELS + """
, n AS (SELECT row_id, id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vector_index WHERE vec IS NOT NULL)
SELECT row_id, n.id, coalesce(l.label, 'unknown') AS label, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 5) AS first_value
FROM n LEFT JOIN lab l ON n.id = l.id""")
def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index's vectors normalized and labelled from the label lines."""
    rows = table(spark, folder, "vector_index").where(F.col("vec").isNotNull()).select("row_id", "id", "vec")
    index = sinks.build_index(rows, labels.label_table(table(spark, folder, "label_text")))
    return index.select("row_id", "id", "label", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first_value"))


@query(SQL_LABELS + """
SELECT count(*) AS rows, CAST(count(*) FILTER (coalesce(l.label, 'unknown') = 'unknown') AS BIGINT) AS unknown FROM vector_index v LEFT JOIN lab l ON v.id = l.id""")
def unknown_labels(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.unknown_labels(build_index_labels(spark, folder))


@query(SQL_LABELS + "SELECT row_id, e.id, l.label FROM embedding_store e JOIN lab l ON e.id = l.id")
def label_semi(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embedding_store").select("row_id", "id")
    return encode.with_labels(rows, labels.label_table(table(spark, folder, "label_text")))[0].select("row_id", "id", "label")


@query(SQL_LABELS + "SELECT e.id FROM embedding_store e WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.id = e.id)")
def label_anti(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embedding_store").select("row_id", "id")
    return encode.with_labels(rows, labels.label_table(table(spark, folder, "label_text")))[1]


@query(rf"""
WITH ids AS (SELECT file, pos, {_TOKEN} AS id FROM (SELECT file, pos, line AS h FROM fasta_text) WHERE starts_with(h, '>') AND {_TOKEN} <> '')
SELECT file, pos, id FROM ids WHERE id IN (SELECT id FROM vector_index WHERE id IS NOT NULL)""")
def id_allow_list(spark: SparkSession, folder: str) -> DataFrame:
    return fasta.allowed(fasta.header_ids(table(spark, folder, "fasta_text")), table(spark, folder, "vector_index").select("id")).select("file", "pos", "id")


@query(rf"""
WITH ids AS (SELECT {_TOKEN} AS id FROM (SELECT line AS h FROM fasta_text) WHERE starts_with(h, '>') AND {_TOKEN} <> '')
SELECT i.id, s.row_id, s.label_idx FROM ids i JOIN embedding_store s ON i.id = s.id WHERE s.label_idx IS NOT NULL""")
def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a split: its FASTA ids found in the store with a label, repeated ids included."""
    ids = fasta.header_ids(table(spark, folder, "fasta_text"))
    return train.split_rows(table(spark, folder, "embedding_store"), ids).select("id", "row_id", "label_idx")


@query("""
WITH files AS (SELECT 'd' || vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0 UNION SELECT 'd' || (vec_id + 7) FROM embeddings WHERE vec_id % 4 = 1)
SELECT vec_id AS query_pos, 'd' || vec_id AS query_id, 'd' || (vec_id * 2 % 500) AS target_id FROM embeddings
WHERE 'd' || vec_id IN (SELECT id FROM files) AND 'd' || (vec_id * 2 % 500) IN (SELECT id FROM files)""")
def structure_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Hits whose query and target both have a structure file."""
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    v = F.col("vec_id")
    rows = table(spark, folder, "embeddings").select("vec_id")
    hits = rows.select(v.alias("query_pos"), name(v).alias("query_id"), name(v * 2 % 500).alias("target_id"))
    files = rows.where(v % 3 != 0).select(name(v).alias("id"), F.lit(".cif").alias("ext")).union(rows.where(v % 4 == 1).select(name(v + 7), F.lit(".ent")))
    return structure.resolvable(hits, files.withColumn("path", F.concat("id", "ext"))).select("query_pos", "query_id", "target_id")


@query(SQL_LABELS + """
SELECT a.query_pos, a.query_id, a.predicted_annotation, coalesce(l.label, 'unknown') AS true_annotation FROM annotations a LEFT JOIN lab l ON a.query_id = l.id""")
def attach_truth(spark: SparkSession, folder: str) -> DataFrame:
    found = ann.attach_truth(table(spark, folder, "annotations"), labels.label_table(table(spark, folder, "label_text")))
    return found.select("query_pos", "query_id", "predicted_annotation", "true_annotation")


@query("""
SELECT a.query_pos, a.query_id, v.id AS target_id FROM annotations a JOIN vector_index v ON a.top1_db_row = v.row_id
WHERE a.top1_db_row >= 0 AND a.predicted_annotation NOT IN ('unknown', 'missing_embedding')""")
def top_hits(spark: SparkSession, folder: str) -> DataFrame:
    return ann.top_hits(table(spark, folder, "annotations"), table(spark, folder, "vector_index"))


# ---- search and vote ----------------------------------------------------------------------------------------------


@query(_neighbours_sql(5) + "SELECT query_pos, CAST(rank AS INTEGER) AS rank, db_row, round(similarity, 6) AS similarity, round(distance, 6) AS distance FROM nn")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = _embeddings(spark, folder)
    near = knn.knn_join(_queries(e), _index(e), 5, exclude_self=True)
    return near.select("query_pos", "rank", "db_row", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@query(_neighbours_sql(5) + "SELECT query_pos, CAST(rank AS INTEGER) AS rank, db_row, round(similarity, 6) AS similarity, round(distance, 6) AS distance FROM nn")
def cosine_topk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the path for an index too large to broadcast."""
    e = _embeddings(spark, folder)
    near = knn.knn_join(_queries(e), _index(e), 5, exclude_self=True, strategy="two_phase", block_rows=256)
    return near.select("query_pos", "rank", "db_row", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


def _leave_one_out(spark: SparkSession, folder: str, k: int, cutoff: float = 1.0) -> DataFrame:
    e = _embeddings(spark, folder)
    return _voted(ann.annotate(_queries(e), _index(e), k, cutoff, exclude_self=True))


@query(_neighbours_sql(1) + _vote_sql(1, 1.0, "'c' || label") + _VOTED)
def knn_vote_k1(spark: SparkSession, folder: str) -> DataFrame:
    return _leave_one_out(spark, folder, 1)


@query(_neighbours_sql(5) + _vote_sql(5, 1.0, "'c' || label") + _VOTED)
def knn_vote_k5(spark: SparkSession, folder: str) -> DataFrame:
    return _leave_one_out(spark, folder, 5)


@query(_neighbours_sql(15) + _vote_sql(15, 1.0, "'c' || label") + _VOTED)
def knn_vote_k15(spark: SparkSession, folder: str) -> DataFrame:
    return _leave_one_out(spark, folder, 15)


@query(_neighbours_sql(5) + _vote_sql(5, 0.65, "'c' || label") + _VOTED)
def knn_vote_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return _leave_one_out(spark, folder, 5, 0.65)


@query(SQL_UNIT + """
, sums AS (SELECT label, i, sum(u[i]) AS s FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
centre AS (SELECT label, list(s ORDER BY i) AS v FROM sums GROUP BY label),
means AS (SELECT label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS m FROM centre),
pairs AS (SELECT vec_id AS query_pos, CAST(d.label AS BIGINT) AS db_row, d.label, round(list_inner_product(u, m), 10) AS similarity FROM unit CROSS JOIN means d),
nn AS (SELECT *, 1.0 - similarity AS distance, row_number() OVER (PARTITION BY query_pos ORDER BY similarity DESC, db_row) AS rank FROM pairs QUALIFY rank <= 15)
""" + _vote_sql(15, 1.0, "'c' || label") + _VOTED)
def knn_vote_underfill(spark: SparkSession, folder: str) -> DataFrame:
    """More neighbours asked for than the index of class means has."""
    e = _embeddings(spark, folder)
    index = _class_means(e).select(F.col("label").cast("bigint").alias("row_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), "vec")
    return _voted(ann.annotate(_queries(e), index, 15))


def _class_means(e: DataFrame) -> DataFrame:
    """``label, vec``: per class the sum of its unit vectors, whose direction is the mean's."""
    u = e.select("label", F.posexplode(vectors.l2_normalize(F.col("vec"))).alias("i", "x"))
    sums = u.groupBy("label", "i").agg(F.sum("x").alias("s"))
    # as many entries as a vector has values
    return sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p.s).alias("vec"))


@query(_neighbours_sql(5) + _vote_sql(5, 1.0, "CASE WHEN db_row % 3 <> 0 THEN 'f' || (db_row % 4) END") + _VOTED)
def knn_vote_id_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """An index without labels: ids looked up in a table that lacks a third of them."""
    e = _embeddings(spark, folder)
    index = _index(e).drop("label")
    mapping = index.where(F.col("row_id") % 3 != 0).select("id", F.concat(F.lit("f"), (F.col("row_id") % 4).cast("string")).alias("label"))
    return _voted(ann.annotate(_queries(e), index, 5, labels=mapping, exclude_self=True))


@query(_neighbours_sql(3, query_where="q.vec_id % 7 <> 0") + _vote_sql(3, 1.0, "'c' || label") + """
SELECT e.vec_id AS query_pos, CASE WHEN e.vec_id % 7 = 0 THEN 'missing_embedding' ELSE predicted_annotation END AS predicted_annotation,
       round(distance, 6) AS distance, round(confidence, 6) AS confidence, coalesce(top1_db_row, -1) AS top1_db_row
FROM embeddings e LEFT JOIN voted v ON e.vec_id = v.query_pos""")
def missing_embedding_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = _embeddings(spark, folder)
    queries = _queries(e).withColumn("vec", F.when(F.col("query_pos") % 7 != 0, F.col("vec")))
    return _voted(ann.annotate(queries, _index(e), 3, exclude_self=True))


@query("""
WITH unit AS (
  SELECT row_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u
  FROM (SELECT row_id, label, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vector_index WHERE vec IS NOT NULL)),
pairs AS (SELECT q.row_id AS query_pos, d.row_id AS db_row, d.label, round(list_inner_product(q.u, d.u), 10) AS similarity
          FROM unit q JOIN unit d ON q.row_id <> d.row_id WHERE q.row_id % 100 = 0),
nn AS (SELECT *, 1.0 - similarity AS distance, row_number() OVER (PARTITION BY query_pos ORDER BY similarity DESC, db_row) AS rank FROM pairs QUALIFY rank <= 5)
""" + _vote_sql(5, 0.5, "label") + _VOTED)
def knn_vote_index(spark: SparkSession, folder: str) -> DataFrame:
    """The reference index against itself: every hundredth id asks all rows; a label ``unknown`` is a label."""
    index = table(spark, folder, "vector_index").where(F.col("vec").isNotNull())
    queries = index.where(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_pos"), F.col("id").alias("query_id"), "vec")
    return _voted(ann.annotate(queries, index, 5, 0.5, exclude_self=True))


@query(SQL_UNIT + """
, sums AS (SELECT label, i, sum(u[i]) AS s FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
centre AS (SELECT label, list(s ORDER BY i) AS v FROM sums GROUP BY label),
means AS (SELECT label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS m FROM centre),
pairs AS (SELECT vec_id AS query_pos, CAST(d.label AS BIGINT) AS db_row, round(list_inner_product(u, m), 10) AS similarity FROM unit CROSS JOIN means d),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY similarity DESC, db_row) AS rank FROM pairs QUALIFY rank <= 12)
SELECT e.vec_id AS query_pos, CAST(r.rank AS INTEGER) AS rank, coalesce(db_row, -1) AS db_row, round(coalesce(similarity, 0.0), 6) AS similarity
FROM embeddings e CROSS JOIN (SELECT unnest(range(1, 13)) AS rank) r LEFT JOIN nn ON nn.query_pos = e.vec_id AND nn.rank = r.rank""")
def knn_padded(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve places per query over an index of ten class means."""
    e = _embeddings(spark, folder)
    index = _class_means(e).select(F.col("label").cast("bigint").alias("row_id"), "vec")
    found = knn.padded(knn.knn_join(_queries(e), index, 12), _queries(e), 12)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT count(*) AS rows, CAST(max(len(vec)) AS INTEGER) AS dim FROM vector_index")
def index_size(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.index_size(table(spark, folder, "vector_index"))


# ---- metrics and aggregates ---------------------------------------------------------------------------------------

_ANNOTATED = "predicted_annotation NOT IN ('unknown', 'missing_embedding')"


@query(f"""
SELECT count(*) AS total, count(*) FILTER ({_ANNOTATED}) AS annotated, count(*) FILTER (predicted_annotation = 'unknown') AS unknown,
       count(*) FILTER (predicted_annotation = 'missing_embedding') AS missing, count(confidence) FILTER ({_ANNOTATED}) AS confidences,
       round(avg(confidence) FILTER ({_ANNOTATED}), 6) AS mean_confidence FROM annotations""")
def annotation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summarize(table(spark, folder, "annotations")).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"""
SELECT count(*) AS evaluated, round(coalesce(avg(CAST(predicted_annotation = coalesce(true_annotation, 'unknown') AS DOUBLE)), 0.0), 6) AS accuracy
FROM annotations WHERE {_ANNOTATED}""")
def annotation_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "annotations").withColumn("true_annotation", ann.decode(F.col("true_annotation")))
    return metrics.annotation_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


SQL_CURVE = """
WITH r AS (SELECT distance AS d, predicted_annotation = coalesce(true_annotation, 'unknown') AS ok FROM annotations WHERE distance IS NOT NULL AND NOT isnan(distance)),
e AS (SELECT min(d) AS lo, max(d) AS hi FROM r),
t AS (SELECT CASE WHEN i = 49 THEN hi ELSE lo + i * (hi - lo) / 49 END AS t FROM e, (SELECT unnest(range(50)) AS i))
SELECT round(t, 6) AS threshold, round(avg(CAST(d <= t AS DOUBLE)), 6) AS coverage, round(coalesce(avg(CASE WHEN d <= t THEN CAST(ok AS DOUBLE) END), 0.0), 6) AS accuracy
FROM t, r GROUP BY t"""


@query(SQL_CURVE)
def selective_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "annotations").withColumn("true_annotation", ann.decode(F.col("true_annotation")))
    return metrics.selective_curve(rows).select(*[F.round(c, 6).alias(c) for c in ("threshold", "coverage", "accuracy")])


def _own_labels(e: DataFrame) -> DataFrame:
    return e.select(F.col("vec_id").alias("query_pos"), "vec", "label", (F.col("vec_id") % 3).alias("part"))


@query(_neighbours_sql(1) + """
SELECT count(*) AS evaluated, round(coalesce(avg(CAST(n.label = e.label AS DOUBLE)), 0.0), 6) AS accuracy FROM nn n JOIN embeddings e ON n.query_pos = e.vec_id""")
def nn1_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    e = _embeddings(spark, folder)
    index = e.select(F.col("vec_id").alias("row_id"), "vec", "label")
    return metrics.nearest_label_accuracy(_own_labels(e), index, exclude_self=True).withColumn("accuracy", F.round("accuracy", 6))


@query(_neighbours_sql(1) + """
SELECT query_pos % 3 AS part, count(*) AS evaluated, round(coalesce(avg(CAST(n.label = e.label AS DOUBLE)), 0.0), 6) AS accuracy
FROM nn n JOIN embeddings e ON n.query_pos = e.vec_id GROUP BY 1""")
def nn1_accuracy_per_split(spark: SparkSession, folder: str) -> DataFrame:
    e = _embeddings(spark, folder)
    index = e.select(F.col("vec_id").alias("row_id"), "vec", "label")
    return metrics.nearest_label_accuracy(_own_labels(e), index, by=["part"], exclude_self=True).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) AS classes FROM label_vocab")
def class_count(spark: SparkSession, folder: str) -> DataFrame:
    return store.class_count(table(spark, folder, "label_vocab"))


@query("SELECT DISTINCT label_idx, CAST(label_idx AS VARCHAR) AS label FROM embedding_store WHERE label_idx IS NOT NULL")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return store.fallback_vocabulary(table(spark, folder, "embedding_store"))


@query(SQL_UNIT + """
, pairs AS (
  SELECT a.vec_id // 64 AS batch, a.vec_id AS i, a.vec_id = b.vec_id AS self, a.label = b.label AND a.vec_id <> b.vec_id AS positive, list_inner_product(a.u, b.u) / 0.07 AS s
  FROM unit a JOIN unit b ON a.vec_id // 64 = b.vec_id // 64),
shifted AS (SELECT *, s - max(s) OVER (PARTITION BY i) AS t FROM pairs),
anchor AS (
  SELECT batch, i, ln(greatest(sum(CASE WHEN NOT self THEN exp(t) ELSE 0 END), 1e-12)) AS z, sum(CASE WHEN positive THEN t ELSE 0 END) AS p, count(*) FILTER (positive) AS n
  FROM shifted GROUP BY batch, i)
SELECT batch, count(*) FILTER (n > 0) AS anchors, round(coalesce(-avg(CASE WHEN n > 0 THEN p / n - z END), 0.0), 6) AS loss FROM anchor GROUP BY batch""")
def supcon_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = _embeddings(spark, folder).select(F.floor(F.col("vec_id") / 64).cast("bigint").alias("batch"), F.col("vec_id").alias("item"), "vec", "label")
    return losses.supcon_loss(rows, normalize=True).withColumn("loss", F.round("loss", 6))


@query(SQL_UNIT + """
, sums AS (SELECT label, i, sum(u[i]) AS s FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
centre AS (SELECT label, list(s ORDER BY i) AS v FROM sums GROUP BY label),
proxies AS (SELECT label AS c, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS p FROM centre),
pairs AS (SELECT vec_id // 64 AS batch, c, label = c AS own, list_inner_product(u, p) AS cs FROM unit CROSS JOIN proxies),
cls AS (SELECT batch, c, sum(CASE WHEN own THEN exp(-32 * (cs - 0.1)) ELSE 0 END) AS pos, sum(CASE WHEN own THEN 0 ELSE exp(32 * (cs + 0.1)) END) AS neg,
               count(*) FILTER (own) AS n FROM pairs GROUP BY batch, c)
SELECT batch, count(*) FILTER (n > 0) AS present,
       round(sum(CASE WHEN n > 0 THEN ln(1 + pos) ELSE 0 END) / greatest(count(*) FILTER (n > 0), 1) + avg(ln(1 + neg)), 6) AS loss FROM cls GROUP BY batch""")
def proxy_anchor_loss(spark: SparkSession, folder: str) -> DataFrame:
    e = _embeddings(spark, folder)
    rows = e.select(F.floor(F.col("vec_id") / 64).cast("bigint").alias("batch"), "vec", "label")
    return losses.proxy_anchor_loss(rows, _class_means(e)).withColumn("loss", F.round("loss", 6))


# ---- order and packing --------------------------------------------------------------------------------------------


@query("""
WITH last AS (SELECT query_id, max(query_pos) AS l FROM annotations GROUP BY query_id)
SELECT a.query_id, a.query_pos, row_number() OVER (ORDER BY l, query_pos) - 1 AS position
FROM annotations a JOIN last ON a.query_id IS NOT DISTINCT FROM last.query_id""")
def ordered_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return ann.in_query_order(table(spark, folder, "annotations").select("query_pos", "query_id")).select("query_id", "query_pos", "position")


SQL_BATCHES = SQL_SEQUENCES.replace("WITH kept", "WITH RECURSIVE kept") + """
, o AS (SELECT file, id, length, row_number() OVER (PARTITION BY file ORDER BY length DESC, pos) AS n FROM seqs),
fold AS (
  SELECT file, id, length, n, 0 AS batch, CASE WHEN length >= 4000 OR length > 1000 OR 1 >= 100 THEN 0 ELSE 1 END AS items,
         CASE WHEN length >= 4000 OR length > 1000 THEN 0 ELSE length END AS total, CASE WHEN length >= 4000 OR length > 1000 THEN 1 ELSE 0 END AS next
  FROM o WHERE n = 1
  UNION ALL
  SELECT o.file, o.id, o.length, o.n, f.next, CASE WHEN shut THEN 0 ELSE f.items + 1 END, CASE WHEN shut THEN 0 ELSE f.total + o.length END, CASE WHEN shut THEN f.next + 1 ELSE f.next END
  FROM (SELECT *, 0 AS z FROM fold) f JOIN o ON o.file = f.file AND o.n = f.n + 1,
       LATERAL (SELECT f.items + 1 >= 100 OR f.total + o.length >= 4000 OR o.length > 1000 AS shut))
"""


@query(SQL_BATCHES + "SELECT file, id, CAST(batch AS INTEGER) AS batch FROM fold")
def encoder_batches(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encoder_batches(fasta.sequences(table(spark, folder, "fasta_text"))).select("file", "id", "batch")


@query(SQL_BATCHES + """
, bad AS (SELECT DISTINCT file, batch FROM fold WHERE length > 0 AND length % 97 = 0)
SELECT f.file, f.id, CASE WHEN b.batch IS NOT NULL THEN 'ValueError: a length that 97 divides' END AS failure
FROM fold f LEFT JOIN bad b ON f.file = b.file AND f.batch = b.batch WHERE f.length > 0
UNION ALL SELECT file, id, 'empty sequence' FROM fold WHERE length = 0""")
def encoded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Which sequences an encoder gives vectors for that refuses batches by a length in them."""
    return encode.encode_all(fasta.sequences(table(spark, folder, "fasta_text")), lambda: encode.RefusingEncoder(97)).select("file", "id", "failure")


# ---- sinks, read back ---------------------------------------------------------------------------------------------

_PREDICTIONS = ["query_id", "predicted_annotation", "true_annotation", "distance", "confidence", "tm_score", "rmsd", "tm_coverage"]
_SQL_REPORT = """
WITH last AS (SELECT query_id, max(query_pos) AS l FROM annotations GROUP BY query_id)
SELECT nullif(a.query_id, '') AS query_id, predicted_annotation, true_annotation, distance, confidence, tm_score, rmsd, tm_coverage
FROM annotations a JOIN last ON a.query_id IS NOT DISTINCT FROM last.query_id"""


def _report(spark: SparkSession, folder: str, parts: bool) -> DataFrame:
    at = shared_path(spark, "report")
    rows = ann.in_query_order(table(spark, folder, "annotations")).orderBy("position")
    columns = sinks.prediction_columns(truth=True, distance=True, confidence=True, structure=True)
    (sinks.write_tsv_parts if parts else sinks.write_tsv)(rows, at, columns)
    return sinks.read_tsv(spark, at, ", ".join(f"{c} {'string' if i < 3 else 'double'}" for i, c in enumerate(_PREDICTIONS)))


@query(_SQL_REPORT)
def prediction_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of all predictions as one file, read back by its header."""
    return _report(spark, folder, parts=False)


@query(_SQL_REPORT)
def prediction_report_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a folder of parts."""
    return _report(spark, folder, parts=True)


@query(f"""
SELECT count(*) AS evaluated, round(coalesce(avg(CAST(predicted_annotation = coalesce(true_annotation, 'unknown') AS DOUBLE)), 0.0), 6) AS accuracy
FROM annotations WHERE {_ANNOTATED}""")
def metrics_report(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics file, read back."""
    at = shared_path(spark, "metrics.json")
    rows = table(spark, folder, "annotations").withColumn("true_annotation", ann.decode(F.col("true_annotation")))
    sinks.write_metrics(metrics.annotation_accuracy(rows), at)
    return spark.read.option("multiLine", True).schema("evaluated bigint, accuracy double").json(at).withColumn("accuracy", F.round("accuracy", 6))


@query(SQL_CURVE)
def curve_report(spark: SparkSession, folder: str) -> DataFrame:
    """The curve file, read back."""
    at = shared_path(spark, "curve.tsv")
    rows = table(spark, folder, "annotations").withColumn("true_annotation", ann.decode(F.col("true_annotation")))
    sinks.write_tsv(metrics.selective_curve(rows).orderBy("threshold"), at, ["threshold", "coverage", "accuracy"])
    return sinks.read_tsv(spark, at, "threshold double, coverage double, accuracy double").select(*[F.round(c, 6).alias(c) for c in ("threshold", "coverage", "accuracy")])


@query(SQL_LABELS + """
, n AS (SELECT row_id, id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vector_index WHERE vec IS NOT NULL)
SELECT row_id, n.id, coalesce(l.label, 'unknown') AS label, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 5) AS first_value
FROM n LEFT JOIN lab l ON n.id = l.id""")
def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of ``build_index`` written and read back."""
    at = shared_path(spark, "index")
    rows = table(spark, folder, "vector_index").where(F.col("vec").isNotNull()).select("row_id", "id", "vec")
    sinks.write_index(sinks.build_index(rows, labels.label_table(table(spark, folder, "label_text"))), at)
    return sinks.read_index(spark, at).select("row_id", "id", "label", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first_value"))


_WHOLE = "id IS NOT NULL AND len(embedding) = 64"


@query(f"SELECT row_id, id, label_idx, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[64] AS DOUBLE), 5) AS last_value FROM embedding_store WHERE {_WHOLE}")
def stored_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """A store made, kept, and found again by the resolver, which checks it against its metadata."""
    at = shared_path(spark, "store")
    rows = table(spark, folder, "embedding_store").where(F.col("id").isNotNull() & (F.size("embedding") == 64)).select("row_id", "id", "embedding", "label_idx")
    store.resolve_store(spark, at, lambda: rows)
    found = store.resolve_store(spark, at)
    return found.select("row_id", "id", "label_idx", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(63)).cast("double"), 5).alias("last_value"))


@query("SELECT label_idx, label FROM label_vocab")
def stored_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The label names of a store's metadata, read back from its sidecar."""
    at = shared_path(spark, "store")
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("id"), "embedding")
    # one row per class
    names = {r["label_idx"]: r["label"] for r in table(spark, folder, "label_vocab").collect()}
    store.write_store(rows, at, source="embeddings", vocabulary=names)
    return spark.createDataFrame(list(store.vocabulary_of(at, store.read_store(spark, at)[1]).items()), "label_idx bigint, label string")


def _fasta_folder(spark: SparkSession, folder: str) -> str:
    """A folder of FASTA files, one for each ``file`` of the lines."""
    at = shared_path(spark, "fasta")
    lines = table(spark, folder, "fasta_text").where(F.col("line").isNotNull())
    # a few files; each one's lines stream through the driver
    for (name,) in lines.select("file").distinct().collect():
        own = lines.where(F.col("file") == name).orderBy("pos").select("line")
        paths.write_lines(paths.join(at, name), (r["line"] + "\n" for r in own.toLocalIterator()))
    return at


@query(SQL_SEQUENCES + "SELECT file, id, sequence FROM seqs")
def fasta_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences of a folder of FASTA files."""
    at = _fasta_folder(spark, folder)
    rows = fasta.sequences(fasta.read_lines(spark, at))
    return rows.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "id", "sequence")


@query(SQL_SEQUENCES + SQL_LABELS.replace("WITH toks", ", toks", 1) + f"""
, coded AS (
  SELECT row_number() OVER (ORDER BY file, pos) - 1 AS row_id, id,
         list_transform({list(encode.RESIDUES)}, lambda r: (length(s) - length(replace(s, r, ''))) / length(s)) AS v
  FROM (SELECT file, pos, id, translate(sequence, 'UZO', 'XXX') AS s FROM seqs) WHERE s <> ''),
units AS (
  SELECT row_id, c.id, coalesce(l.label, 'unknown') AS label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u FROM coded c LEFT JOIN lab l ON c.id = l.id),
heads AS (SELECT file, pos, {_TOKEN} AS id, row_number() OVER (ORDER BY file, pos) AS query_pos FROM (SELECT file, pos, line AS h FROM fasta_text) WHERE starts_with(h, '>') AND {_TOKEN} <> ''),
pairs AS (SELECT query_pos, d.row_id AS db_row, d.label, round(list_inner_product(q.u, d.u), 6) AS similarity FROM heads h JOIN units q ON h.id = q.id JOIN units d ON TRUE),
nn AS (SELECT *, 1.0 - similarity AS distance, row_number() OVER (PARTITION BY query_pos ORDER BY similarity DESC, db_row) AS rank FROM pairs QUALIFY rank <= 1)
""" + _vote_sql(1, 1.0, "label") + """
SELECT h.file, h.id AS query_id, coalesce(predicted_annotation, 'missing_embedding') AS predicted_annotation, coalesce(l.label, 'unknown') AS true_annotation,
       round(abs(distance), 3) AS distance, confidence
FROM heads h LEFT JOIN voted v ON h.query_pos = v.query_pos LEFT JOIN lab l ON h.id = l.id""")
def annotation_run(spark: SparkSession, folder: str) -> DataFrame:
    """FASTA files encoded into a store, made an index of, and annotated against it, read from the reports."""
    at, store_at, index_at, label_at = _fasta_folder(spark, folder), shared_path(spark, "store"), shared_path(spark, "index"), shared_path(spark, "labels.txt")
    lines = table(spark, folder, "label_text").where(F.col("line").isNotNull()).orderBy("pos").select("line")
    paths.write_lines(label_at, (r["line"] + "\n" for r in lines.toLocalIterator()))
    config = encode.EncodeConfig(dtype="float32")
    runs.run_embed(spark, EmbedConfig(input=at, output_dir=store_at, encode=config), encode.CompositionEncoder)
    runs.run_build_index(spark, IndexConfig(input=at, store=store_at, label_file=label_at, output=index_at, dtype="float32", encode=config), encode.CompositionEncoder)
    reports = runs.run_annotate(spark, AnnotateConfig(
        input=at, index=index_at, store=store_at, label_file=label_at, output_dir=shared_path(spark, "out"), return_true_annotation=True, return_confidence=True, encode=config,
    ), encode.CompositionEncoder)
    files = {paths.stem_of(n): n for n in paths.names(at)}
    kinds = "query_id string, predicted_annotation string, true_annotation string, distance double, confidence double"
    rows = None
    for stem, report in reports.items():
        one = sinks.read_tsv(spark, report, kinds).select(F.lit(files[stem]).alias("file"), "query_id", "predicted_annotation", "true_annotation", F.round(F.abs("distance"), 3).alias("distance"), "confidence")
        rows = one if rows is None else rows.union(one)
    return rows


@query(f"SELECT query_pos, confidence FROM annotations WHERE {_ANNOTATED} AND confidence IS NOT NULL")
def annotation_confidences(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confidences(table(spark, folder, "annotations"))


@query("SELECT round(avg(CAST(predicted_annotation = true_annotation AS DOUBLE)), 6) AS accuracy FROM annotations")
def column_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accuracy(table(spark, folder, "annotations"), "predicted_annotation", "true_annotation").select(F.round("accuracy", 6).alias("accuracy"))


@query(SQL_RECORDS + SQL_PARAMETERS + """
, sized AS (SELECT superfamily, count(*) AS records FROM sf WHERE superfamily IS NOT NULL GROUP BY 1)
SELECT superfamily, records FROM sized
WHERE records BETWEEN (SELECT value FROM params WHERE item = 'min_sf_size') AND (SELECT value FROM params WHERE item = 'max_sf_size')
ORDER BY superfamily LIMIT (SELECT CAST(value AS BIGINT) FROM params WHERE item = 'holdout_sf_count')""")
def holdout_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Hold-out classes: sizes within the range in force, as many as it asks for, in order of their index instead of a draw."""
    now = parameters(table(spark, folder, "split_summary"))
    least, most, n = (now[p] for p in ("min_sf_size", "max_sf_size", "holdout_sf_count"))
    sizes = records_with_superfamily(spark, folder).where(F.col("superfamily").isNotNull()).groupBy("superfamily").agg(F.count(F.lit(1)).alias("records"))
    return sizes.where(F.col("records").between(least, most)).orderBy("superfamily").limit(int(n))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
