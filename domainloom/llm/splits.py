"""Splits that keep related records together: contract the entity graph, then deal its components to splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import number_rows
from ..session import dropped, stage
from .components import contract, named_roots

#: Hands that the components of a size band are dealt into.
HANDS = 256


def _node(key: str) -> Column:
    return F.when(F.col(key).isNotNull(), F.concat(F.lit(f"{key}:"), F.col(key).cast("string")))


def tie_edges(records: DataFrame, keys: list[str]) -> DataFrame | None:
    """``a, b, w``: the key values that records have together, with minus their number as weight; None for a single key."""
    edges = None
    for other in keys[1:]:
        # every key is tied to the record's first key, or, where that is null, to the first one it has
        first = F.coalesce(*[_node(k) for k in keys[: keys.index(other)]])
        pair = records.select(first.alias("a"), _node(other).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
        edges = pair if edges is None else edges.union(pair)
    return None if edges is None else edges.groupBy("a", "b").agg((-F.count(F.lit(1))).alias("w"))


def related(records: DataFrame, keys: list[str], id_col: str = "row_id", forest_path: str | None = None) -> DataFrame:
    """``records`` with ``root``: the same for all records that share a value of any of ``keys``, directly or through others.

    The graph's nodes are key values, an edge joins two values that one record
    has, and its weight is minus the number of such records, so the contraction
    takes the strongest ties first.  The spanning forest is a written table; with
    ``forest_path`` it is kept there (``nodes``: ``node, n``; ``forest``: ``a, b, w``
    by these numbers).  Null keys tie nothing; a record without any key is an
    entity of its own.
    """
    own = F.coalesce(*[_node(k) for k in keys], F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    weighted = tie_edges(records, keys)
    if weighted is None:
        return records.withColumn("root", own)
    nodes, _, roots = contract(stage(weighted), forest_path)
    of_node = stage(named_roots(nodes, roots).withColumnRenamed("node", "_node"))
    named = records.drop("root").withColumn("_node", own)
    return named.join(of_node, "_node", "left").withColumn("root", F.coalesce("root", "_node")).drop("_node")


def hand_plan(hands: list[tuple[int, int, int]], fractions: dict[str, float]) -> dict[tuple[int, int], str]:
    """The split of every ``(band, hand, records)``.

    Bands go from the largest components to the smallest.  Within one, the hands
    are laid end to end by their records, the line is cut in proportion to what
    each split still lacks, and a hand goes to the split that its middle lies in:
    a systematic deal, whose error in one band is made up for in the next.
    """
    whole = sum(fractions.values())
    total = sum(n for _, _, n in hands)
    lack = {s: f / whole * total for s, f in fractions.items()}
    out: dict[tuple[int, int], str] = {}
    for band in sorted({b for b, _, _ in hands}, reverse=True):
        inside = sorted((h, n) for b, h, n in hands if b == band)
        line = sum(n for _, n in inside)
        open_ = {s: max(v, 0.0) for s, v in lack.items()}
        scale = line / (sum(open_.values()) or 1.0)
        ends, reached = [], 0.0
        for s, v in open_.items():
            reached += v * scale
            ends.append((reached, s))
        at = 0
        for h, n in inside:
            to = next((s for end, s in ends if at + n / 2 < end), ends[-1][1])
            out[band, h] = to
            lack[to] -= n
            at += n
    return out


def deal(sizes: DataFrame, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """``root, assigned`` for ``sizes (root, n)``: whole components dealt to the splits in proportion ``fractions``.

    Components are stratified by size band (powers of two).  In every band, in an
    order drawn by ``seed``, they are dealt round into ``HANDS`` hands, the k-th
    into hand k mod ``HANDS``, and ``hand_plan`` gives the hands to splits.  The
    driver sees the records of each hand only, at most 64 x ``HANDS`` numbers
    however many components there are.
    """
    order = F.xxhash64(F.lit(seed), F.col("root"))
    banded = sizes.select("root", "n", F.floor(F.log2("n") + 1e-12).cast("int").alias("band"), order.alias("_h"))
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = number_rows(banded.repartitionByRange(parts, "band", "_h").sortWithinPartitions("band", "_h", "root"), "band", "_k").withColumn("hand", (F.col("_k") % HANDS).cast("int"))
    sums = dealt.groupBy("band", "hand").agg(F.sum("n").alias("n")).collect()
    plan = hand_plan([(r["band"], r["hand"], r["n"]) for r in sums], fractions)
    to = spark.createDataFrame([(b, h, s) for (b, h), s in plan.items()], "band int, hand int, assigned string")
    return dealt.join(F.broadcast(to), ["band", "hand"]).select("root", "assigned")


def assign_splits(records: DataFrame, keys: list[str], fractions: dict[str, float], id_col: str = "row_id", seed: int = 0, forest_path: str | None = None) -> DataFrame:
    """``records`` with ``root`` and ``assigned``: the split of each record, equal for all records related by ``keys``.

    Every record gets a split; an empty table gives none.  Columns ``root`` and
    ``assigned`` of the input are replaced.
    """
    # read three times: for the edges, for the roots, and with them
    records = stage(records.drop("assigned"))
    rooted = stage(related(records, keys, id_col, forest_path))
    dropped(records)
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return rooted.join(deal(sizes, fractions, seed), "root")


def divided(assigned: DataFrame, key: str, delivered: str = "delivered") -> DataFrame:
    """``key``: its values whose records lie in more than one delivered split; null splits and null keys do not count.

    Only components that the delivery divided are looked into.
    """
    code = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("train", "val", "test", "holdout")) for x in (s, 1 << i)]), F.col(delivered))
    placed = assigned.where(F.col(delivered).isNotNull()).groupBy("root", key).agg(F.bit_or(code).alias("_in"))
    broken = placed.groupBy("root").agg(F.bit_or("_in").alias("_all")).where(F.bit_count("_all") > 1)
    return (
        placed.join(broken.select("root"), "root", "left_semi").where(F.col(key).isNotNull())
        .groupBy(key).agg(F.bit_or("_in").alias("_in")).where(F.bit_count("_in") > 1).select(key)
    )
