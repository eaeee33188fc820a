"""Spanning forests and components of large graphs by minimum-edge contraction (Borůvka)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, stage

#: Edges between components of which one task finishes the contraction (three integers each).
FINISH_EDGES = 20_000
#: Pointer jumps per written table.
JUMPS = 2


def _jump(parents: DataFrame) -> DataFrame:
    """``node, root`` of ``parents (node, parent)``: pointers doubled until they stand still."""
    now = parents.select("node", F.col("parent").alias("root"))
    while True:
        after = now
        for _ in range(JUMPS):
            up = after.select(F.col("node").alias("root"), F.col("root").alias("top"))
            after = after.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("next"), F.col("root").alias("before")).withColumnRenamed("next", "root")
        after = stage(after)
        settled = after.where(F.col("before") != F.col("root")).isEmpty()
        now = after.select("node", "root")
        if settled:
            return now


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kruskal over the edges between components: ``kind 0`` rows are forest edges (their number), ``kind 1`` rows give a component's root."""
    parts = list(frames)
    if not parts:
        return
    pdf = pd.concat(parts).sort_values(["w", "a", "b"], kind="stable")
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    taken = []
    for a, b, w, x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), pdf["x"].tolist(), pdf["y"].tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            taken.append((0, a, b, w))
    yield pd.DataFrame(taken + [(1, x, root(x), 0) for x in list(up)], columns=["kind", "p", "q", "w"])


def forest_of_integers(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> tuple[DataFrame, DataFrame]:
    """``(forest (a, b, w), roots (node, root))`` of ``edges (a, b, w)`` with a < b, integer nodes and weights, no edge repeated.

    Every round each component takes its least edge (ties by the edge's ends, so
    choices never form a longer cycle than two), and components contract along
    them; their number at least halves.  At least one round is run; once at most
    ``finish_edges`` edges lead between components (counted), one task takes the
    least edges of what is left, which the same order makes the same forest.
    """
    # x and y are the components an edge joins now
    live = stage(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    forest, levels = [], []
    left = live.count()
    while left:
        if forest and left <= finish_edges:
            last = stage(live.repartition(1).mapInPandas(_finish, f"kind int, p bigint, q bigint, w {edges.schema['w'].dataType.simpleString()}"))
            forest.append(last.where("kind = 0").select(F.col("p").alias("a"), F.col("q").alias("b"), "w"))
            levels.append(last.where("kind = 1").select(F.col("p").alias("node"), F.col("q").alias("root")))
            break
        sides = live.select(F.col("x").alias("node"), F.col("y").alias("other"), "w", "a", "b").union(live.select("y", "x", "w", "a", "b"))
        least = sides.groupBy("node").agg(F.min(F.struct("w", "a", "b", "other")).alias("m")).select("node", F.col("m.other").alias("other"), "m.a", "m.b", "m.w")
        # two components that chose each other chose the same edge; the lesser becomes the root
        same = Window.partitionBy("a", "b")
        is_root = (F.count(F.lit(1)).over(same) == 2) & (F.min("node").over(same) == F.col("node"))
        chosen = stage(least.withColumn("parent", F.when(is_root, F.col("node")).otherwise(F.col("other"))).drop("other"))
        forest.append(chosen.select("a", "b", "w"))
        parents = chosen.select("node", "parent")
        merged = _jump(parents)
        levels.append(merged)
        before = live
        live = stage(
            live.join(merged.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x")
            .join(merged.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
            .where(F.col("rx") != F.col("ry"))
            .groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"))
            .agg(F.min(F.struct("w", "a", "b")).alias("e"))
            .select("e.a", "e.b", "e.w", "x", "y")
        )
        dropped(before)
        left = live.count()
    if not forest:
        none = edges.limit(0)
        return none.select("a", "b", "w"), none.select(F.col("a").alias("node"), F.col("b").alias("root"))
    picked = forest[0]
    for more in forest[1:]:
        picked = picked.union(more)
    # a node's root is its first component's component's ... of the last round
    roots = levels[0]
    for level in levels[1:]:
        roots = roots.join(level.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # two components that choose each other choose the same edge
    return picked.distinct(), stage(roots)


def contract(edges: DataFrame, path: str | None = None, finish_edges: int = FINISH_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes (node, n), forest (a, b, w), roots (n, root))`` of ``edges (a, b, w)`` between nodes of any type.

    Nodes are numbered once, in their own order, and contracted as integers, so
    equal weights are ordered by the nodes whatever the partitioning.  The root of
    a component is its least number.  Loops, repeated edges and nulls are ignored.
    All steps are joins and map-side-combined minima: nothing of a node's
    neighbourhood is gathered.  With ``path``, nodes and forest are kept there as
    the tables ``nodes`` and ``forest``; else they last as long as the application.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        if path is None:
            return stage(df)
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b", "w")
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct()
    # ranges of nodes in order, so the numbers ascend with the nodes
    nodes = kept(distinct.repartitionByRange(parts, "node").sortWithinPartitions("node").withColumn("n", F.monotonically_increasing_id()), "nodes")
    numbered = (
        clean.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("_b")), "b")
        .groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("w").alias("w"))
    )
    forest, roots = forest_of_integers(numbered, finish_edges)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("n"), F.col("least").alias("root"))
    return nodes, kept(forest, "forest"), stage(named)


def forest_edges(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """``a, b, w`` of a contracted forest with its nodes' own names, a < b."""
    for column in ("a", "b"):
        forest = forest.join(nodes.select(F.col("n").alias(column), F.col("node").alias(f"_{column}")), column)
    return forest.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "w")


def named_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root`` by the nodes' own names."""
    return roots.join(nodes, "n").select("node", F.col("root").alias("n")).join(nodes.withColumnRenamed("node", "_root"), "n").select("node", F.col("_root").alias("root"))


def spanning_forest(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of ``edges (a, b, w)`` and ``node, root`` of every node with an edge; a root is its component's least node."""
    nodes, forest, roots = contract(edges, None, finish_edges)
    return forest_edges(nodes, forest), named_roots(nodes, roots)
