"""Near-duplicate records by adaptive multi-match prefixes over the token sets of their vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, stage
from . import prefix
from .components import forest_of_integers
from .vectokens import DIM, matrix, sketch_close, token_plan, token_sets, verified, with_copy_key

THRESHOLD = 0.97


def copy_groups(vectors: DataFrame, id_col: str, vec_col: str, *keep: str, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """``(members (id_col, *keep, rep), representatives (rep, *keep, vec))``, both written; exact copies share the least id.

    With ``keep`` columns, copies are grouped within equal values of them.
    """
    base = stage(with_copy_key(vectors, id_col, vec_col, *keep, dim=dim))
    groups = base.groupBy("copy", *keep).agg(F.min(id_col).alias("rep"))
    members = stage(base.select(id_col, "copy", *keep).join(groups, ["copy", *keep]).select(id_col, *keep, "rep"))
    first = members.where(F.col(id_col) == F.col("rep")).select("rep")
    representatives = stage(
        base.join(first, F.col(id_col) == F.col("rep"), "left_semi").select(F.col(id_col).alias("rep"), *keep, "vec").dropDuplicates(["rep"])
    )
    dropped(base)
    return members, representatives


def near_candidates(representatives: DataFrame, threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """``a, b`` (a < b), a written table: the pairs of representatives that share as many prefix tokens as they must, with close sketches.

    Each set's prefix is as long as is cheapest for it, and a pair is verified
    only when it shares as many prefix tokens as the shorter prefix asks for.
    Pairs are matched on tokens with their sketches beside them, so far pairs in a
    frequent token's list end in the join and are never written.
    """
    plan = token_plan(representatives.count(), threshold, dim=dim)
    sets = stage(token_sets(representatives, plan, dim=dim))
    exploded = sets.select("rep", F.explode("tokens").alias("token"))
    counts = stage(prefix.shared_tokens(exploded))
    # sketches join while the sets lie by ``rep``
    ordered = prefix.ordered_sets(exploded, counts).join(sets.select("rep", "s0", "s1"), "rep")
    probes = stage(prefix.adaptive_prefixes(ordered, plan.overlap, plan.overlap))
    dropped(sets, counts)
    matched = probes.alias("p").join(probes.alias("q"), "token").where(
        (F.col("p.rep") < F.col("q.rep")) & sketch_close("p", "q", plan.sketch_limit)
    )
    pairs = stage(
        matched.groupBy(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.least("p.level", "q.level")).alias("level"))
        .where(F.col("n") >= F.col("level")).select("a", "b")
    )
    dropped(probes)
    return pairs


def near_representatives(representatives: DataFrame, threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """``a, b, cosine`` (a < b) of all representatives whose cosine reaches ``threshold``."""
    return verified(near_candidates(representatives, threshold, dim), "a", "b", representatives, representatives, threshold, dim)


def link_summary(pairs: DataFrame, representatives: DataFrame, threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """``kind, a, b`` of the pairs of ``representatives (rep, vec, copies)`` whose cosine reaches ``threshold``.

    ``kind`` 0 are edges of a forest, ``kind`` 1 numbers ``b`` of rows that ``a`` is linked to.

    Every task verifies its pairs and keeps a forest and a count per
    representative of what it saw, so a cloud of n near vectors leaves about n rows
    a task instead of n squared links.  The union of the tasks' forests connects
    what all links connect; the counts add up.
    """
    side = lambda c: representatives.select(F.col("rep").alias(c), F.col("vec").alias(f"_v{c}"), F.col("copies").alias(f"_n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}
        links: Counter = Counter()

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for pdf in batches:
            near = np.einsum("ij,ij->i", matrix(pdf["_va"], dim), matrix(pdf["_vb"], dim)) >= threshold
            a, b, na, nb = (pdf[c].to_numpy()[near] for c in ("a", "b", "_na", "_nb"))
            ends, at = np.unique(np.r_[a, b], return_inverse=True)
            for x, n in zip(ends.tolist(), np.bincount(at, np.r_[nb, na], len(ends)).tolist()):
                links[x] += int(n)
            edges = []
            for x, y in zip(a.tolist(), b.tolist()):
                rx, ry = root(x), root(y)
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    edges.append((0, x, y))
            yield pd.DataFrame(edges, columns=["kind", "a", "b"])
        yield pd.DataFrame([(1, x, n) for x, n in links.items()], columns=["kind", "a", "b"])

    return both.mapInPandas(run, "kind int, a bigint, b bigint")


def near_duplicate_pairs(vectors: DataFrame, id_col: str = "row_id", vec_col: str = "embedding", threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """``row_id_a, row_id_b``: every pair of different rows with usable vectors of at least ``threshold`` cosine, smaller id first.

    Vectors that are null, of another length, all zero or hold null or NaN take no
    part.  Exact copies meet as one representative and are written out as pairs
    here only.  Ids are distinct by contract; a repeated id gives no pair with
    itself.  An empty table gives no rows; other columns are ignored.
    """
    members, reps = copy_groups(vectors.select(id_col, vec_col), id_col, vec_col, dim=dim)
    links = near_representatives(reps, threshold, dim).select("a", "b")
    m = members.select(F.col(id_col).alias("i"), "rep")
    across = (
        links.join(m.select(F.col("i").alias("_a"), F.col("rep").alias("a")), "a")
        .join(m.select(F.col("i").alias("_b"), F.col("rep").alias("b")), "b").select("_a", "_b")
    )
    within = m.alias("p").join(m.alias("q"), "rep").where(F.col("p.i") < F.col("q.i")).select(F.col("p.i"), F.col("q.i"))
    return across.union(within).select(F.least("_a", "_b").alias("row_id_a"), F.greatest("_a", "_b").alias("row_id_b"))


def near_duplicate_groups(vectors: DataFrame, id_col: str = "row_id", vec_col: str = "embedding", threshold: float = THRESHOLD, dim: int = DIM) -> DataFrame:
    """One row per input row: ``id_col, id`` (where present), ``group`` and ``links``.

    ``group`` is the least id of the row's class under near-duplicate links, the
    row's own id where it has none or its vector is not usable; ``links`` counts
    the other rows it is linked to, copies included.  Classes come from the forests
    that ``link_summary`` leaves of the links; neither links nor copies are written
    as pairs.  A null id gives a null group.
    """
    keep = [c for c in (id_col, "id") if c in vectors.columns]
    members, reps = copy_groups(vectors.select(id_col, vec_col), id_col, vec_col, dim=dim)
    copies = stage(members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")))
    pairs = near_candidates(reps, threshold, dim)
    links = stage(link_summary(pairs, reps.join(copies, "rep"), threshold, dim))
    dropped(pairs, reps)
    edges = links.where("kind = 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(0).cast("bigint").alias("w"))
    _, roots = forest_of_integers(edges)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    classed = roots.join(least, "root").select(F.col("node").alias("rep"), F.col("least").alias("root"))
    degree = links.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("_near"))
    classes = (
        copies.join(degree, "rep", "left").join(classed, "rep", "left")
        .select("rep", F.coalesce("root", "rep").alias("_group"), (F.col("copies") - 1 + F.coalesce("_near", F.lit(0))).alias("_links"))
    )
    of_row = members.join(classes, "rep").select(F.col(id_col).alias("_row"), "_group", "_links")
    return vectors.select(*keep).join(of_row, F.col(id_col) == F.col("_row"), "left").select(
        *keep, F.coalesce("_group", id_col).alias("group"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("links")
    )
