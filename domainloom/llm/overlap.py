"""Records that two splits share, exactly or nearly: a two-sided prefix-filter join on rare tokens.

The evaluation side's prefixes are the index; the training side probes it.  A
match must pass the length filter (sets of such different sizes could not overlap
enough) and the position filter (what is left after the matched positions could
not make up the overlap); the overlap of what remains is then counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, stage
from .neardup import THRESHOLD, copy_groups
from .prefix import BROADCAST_TOKENS
from .vectokens import DIM, sketch_close, token_plan, token_sets, verified


def _matches(evaluation: DataFrame, training: DataFrame, need: int | None, jaccard: float | None, close: Column | None, carry: tuple[str, ...]) -> DataFrame:
    """``e, t, enough``, written: pairs with a common prefix token that pass length and position filters; ``enough`` tokens must be common."""
    counts = stage(evaluation.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    looked_up = F.broadcast(counts) if counts.count() <= BROADCAST_TOKENS else counts

    def least(size: Column) -> Column:
        return F.lit(need) if need is not None else F.ceil(size * jaccard - 1e-9).cast("int")

    def side(sets: DataFrame) -> DataFrame:
        # positions count from the end, where the tokens that both sides can hold are
        known = (
            sets.select("rep", F.explode("tokens").alias("token")).join(looked_up, "token").groupBy("rep")
            .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).getField("token").alias("ordered"))
        )
        rows = known.join(sets.select("rep", F.size("tokens").alias("size"), *carry), "rep").where(F.size("ordered") >= least(F.col("size")))
        head = F.slice("ordered", 1, F.size("ordered") - least(F.col("size")) + 1)
        return rows.select("rep", "size", (F.col("size") - F.size("ordered")).alias("lead"), *carry, F.posexplode(head).alias("pos", "token"))

    index, probe = stage(side(evaluation)), stage(side(training))
    dropped(counts)
    e, t = index.alias("e"), probe.alias("t")
    if need is not None:
        # both sizes are at least ``need`` already, which is all that a fixed overlap asks of them
        enough, length = F.lit(need), F.lit(True)
    else:
        enough = F.ceil((F.col("e.size") + F.col("t.size")) * (jaccard / (1 + jaccard)) - 1e-9)
        length = (F.col("t.size") >= F.col("e.size") * jaccard - 1e-9) & (F.col("e.size") >= F.col("t.size") * jaccard - 1e-9)
    rest = F.least(F.col("e.size") - F.col("e.lead") - F.col("e.pos"), F.col("t.size") - F.col("t.lead") - F.col("t.pos"))
    matched = e.join(t, "token").where(length & (F.least("e.pos", "t.pos") + rest >= enough) & (close if close is not None else F.lit(True)))
    pairs = stage(matched.select(F.col("e.rep").alias("e"), F.col("t.rep").alias("t"), enough.cast("int").alias("enough")).distinct())
    dropped(index, probe)
    return pairs


def overlap_join(evaluation: DataFrame, training: DataFrame, need: int | None = None, jaccard: float | None = None) -> DataFrame:
    """``e, t`` of all pairs of an evaluation and a training set that overlap enough.

    Both inputs are ``rep bigint, tokens array<bigint>``, tokens distinct within a
    set; enough is ``need`` common tokens, or a Jaccard similarity of ``jaccard``.
    Tokens are ordered by the number of evaluation sets that hold them, rarest
    first; tokens of no evaluation set come first and are never in the index.
    Empty sets match nothing.
    """
    pairs = _matches(evaluation, training, need, jaccard, None, ())
    # the prefix tokens' match is counted over the whole sets: the overlap is exact
    eo = evaluation.select(F.col("rep").alias("e"), F.col("tokens").alias("_et"))
    to = training.select(F.col("rep").alias("t"), F.col("tokens").alias("_tt"))
    return pairs.join(eo, "e").join(to, "t").where(F.size(F.array_intersect("_et", "_tt")) >= F.col("enough")).select("e", "t")


def _sided(records: DataFrame) -> DataFrame:
    """``row_id, domain, embedding, side`` of the records of a known split."""
    return records.where(F.col("split").isNotNull()).select(
        "row_id", "domain", "embedding", F.when(F.col("split") == "train", "t").otherwise("e").alias("side")
    )


def near_across(sided: DataFrame, threshold: float = THRESHOLD, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """``(links (e, t), members (row_id, side, rep))``: representatives of the two sides that are near, and who they stand for."""
    members, reps = copy_groups(sided.select("row_id", "side", "embedding"), "row_id", "embedding", "side", dim=dim)
    plan = token_plan(reps.count(), threshold, dim=dim)
    sets = stage(token_sets(reps, plan, "side", dim=dim))
    both = _matches(
        sets.where(F.col("side") == "e"), sets.where(F.col("side") == "t"), plan.overlap, None,
        sketch_close("e", "t", plan.sketch_limit), ("s0", "s1"),
    )
    dropped(sets)
    # the tokens of a pair are counted again from its vectors, where the cosine is, so no token set is fetched
    return verified(both.select("e", "t"), "e", "t", reps, reps, threshold, dim, plan).select("e", "t"), members


def cross_split_pairs(records: DataFrame, threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """``row_id_a, row_id_b``: every pair of one train row and one row of another split with the same domain or near vectors.

    Input: ``row_id, domain, split, embedding`` with ``split`` one of train, val,
    test, holdout (rows of none take no part); other columns are ignored.  A null
    domain equals no other; unusable vectors have no near ones.  Each pair is
    given once, smaller id first.  Empty sides give no rows.
    """
    sided = _sided(records)
    links, members = near_across(sided, threshold, dim)
    e = members.where(F.col("side") == "e").select(F.col("row_id").alias("_e"), F.col("rep").alias("e"))
    t = members.where(F.col("side") == "t").select(F.col("row_id").alias("_t"), F.col("rep").alias("t"))
    near = links.join(e, "e").join(t, "t").select("_e", "_t")
    named = sided.where(F.col("domain").isNotNull()).select("row_id", "domain", "side")
    same = (
        named.where(F.col("side") == "e").select(F.col("row_id").alias("_e"), "domain")
        .join(named.where(F.col("side") == "t").select(F.col("row_id").alias("_t"), "domain"), "domain").select("_e", "_t")
    )
    return near.union(same).distinct().select(F.least("_e", "_t").alias("row_id_a"), F.greatest("_e", "_t").alias("row_id_b"))


def overlap_report(records: DataFrame, threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """``split, source, records, same_domain, near, overlapping`` per evaluation split and source (null sources kept as one).

    Counts evaluation rows: those whose domain a train row has, those with a near
    train vector, and those with either.  A last row of split ``train`` and null
    source counts the train rows that either would remove.  Domains and copies
    are matched as keys, so no pair of rows is written.
    """
    sided = _sided(records)
    links, members = near_across(sided, threshold, dim)
    links = stage(links)
    near = (
        members.join(links.select(F.col("e").alias("rep")).union(links.select("t")).distinct(), "rep", "left_semi").select("row_id")
    )
    named = sided.where(F.col("domain").isNotNull())
    both = named.groupBy("domain").agg(F.count_distinct("side").alias("n")).where(F.col("n") == 2)
    same = named.join(both, "domain", "left_semi").select("row_id")
    flagged = stage(
        records.where(F.col("split").isNotNull()).select("row_id", "split", "source")
        .join(same.select("row_id", F.lit(1).alias("_same")).distinct(), "row_id", "left")
        .join(near.select("row_id", F.lit(1).alias("_near")).distinct(), "row_id", "left")
    )
    counts = [
        F.count(F.lit(1)).alias("records"), F.count("_same").alias("same_domain"), F.count("_near").alias("near"),
        F.count(F.coalesce("_same", "_near")).alias("overlapping"),
    ]
    per_source = flagged.where(F.col("split") != "train").groupBy("split", "source").agg(*counts)
    removed = flagged.where(F.col("split") == "train").groupBy("split").agg(*counts)
    return per_source.union(removed.select("split", F.lit(None).cast("string").alias("source"), "records", "same_domain", "near", "overlapping"))
