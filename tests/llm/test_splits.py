from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from domainloom.llm.splits import assign_splits, deal, divided, related
from pyspark.sql import functions as F

FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def records(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        entity = 0 if rng.random() < 0.33 else int(rng.integers(1, 400))
        rows.append((i, None if i % 50 == 0 else entity, None if i % 9 == 0 else f"d{int(rng.integers(0, 2500))}_{entity}", ["train", "val", None, "holdout"][int(rng.integers(0, 4))]))
    return spark.createDataFrame(rows, "row_id bigint, superfamily bigint, domain string, delivered string").withColumns({"root": F.lit("x"), "n": F.lit(1), "band": F.lit(2)})


def test_related_records_stay_together(spark, tmp_path):
    df = records(spark)
    rows = assign_splits(df, ["superfamily", "domain"], FRACTIONS, forest_path=str(tmp_path / "forest")).collect()
    kept = {name: spark.read.parquet(str(tmp_path / "forest" / name)) for name in ("nodes", "forest")}
    tied = {r["root"] for r in rows if r["superfamily"] is not None and r["domain"] is not None}
    assert len(rows) == 3000 and kept["forest"].count() == kept["nodes"].count() - len(tied)
    for key in ("superfamily", "domain"):
        by = defaultdict(set)
        for r in rows:
            if r[key] is not None:
                by[r[key]].add((r["root"], r["assigned"]))
        assert all(len(x) == 1 for x in by.values())
    share = Counter(r["assigned"] for r in rows)
    assert all(abs(share[s] / 3000 - f) < 0.01 for s, f in FRACTIONS.items())
    again = {r["row_id"]: r["assigned"] for r in assign_splits(df.repartition(5), ["superfamily", "domain"], FRACTIONS).collect()}
    assert again == {r["row_id"]: r["assigned"] for r in rows}


def test_roots_follow_chains(spark):
    rows = [(0, 1, "a", None), (1, 2, "a", None), (2, 2, "b", None), (3, None, "b", None), (4, 3, None, None), (5, None, None, None), (6, None, "z", None)]
    df = spark.createDataFrame(rows, "row_id bigint, superfamily bigint, domain string, delivered string")
    root = {r["row_id"]: r["root"] for r in related(df, ["superfamily", "domain"]).collect()}
    assert len({root[i] for i in (0, 1, 2, 3)}) == 1 and len(set(root.values())) == 4
    alone = {r["row_id"]: r["root"] for r in related(df, ["superfamily"]).collect()}
    assert alone[1] == alone[2] and len(set(alone.values())) == 6


def test_many_small_components(spark):
    sizes = spark.range(20000).select(F.concat(F.lit("r"), "id").alias("root"), (1 + F.col("id") % 5).alias("n"))
    got = deal(sizes, FRACTIONS, seed=3).join(sizes, "root").groupBy("assigned").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    total = sum(r["n"] for r in got)
    assert sum(r["c"] for r in got) == 20000 and all(abs(r["n"] / total - FRACTIONS[r["assigned"]]) < 0.005 for r in got)


def test_edge_cases(spark):
    df = records(spark)
    assert assign_splits(df.limit(0), ["superfamily", "domain"], FRACTIONS).count() == 0
    assert assign_splits(df.limit(1), ["superfamily", "domain"], FRACTIONS).count() == 1
    assert {r["assigned"] for r in assign_splits(df.limit(20), ["superfamily"], {"all": 3.0}).collect()} == {"all"}


def test_hands_follow_the_fractions_whatever_the_sizes():
    from domainloom.llm.splits import hand_plan

    hands = [(17, 0, 200_000), (15, 0, 60_000), (15, 1, 50_000), (14, 0, 30_000), (14, 1, 20_000), (14, 2, 17_000)]
    hands += [(b, h, 2**b * 3) for b in range(10) for h in range(256)]
    plan = hand_plan(hands, FRACTIONS)
    got = Counter()
    for b, h, n in hands:
        got[plan[b, h]] += n
    assert all(abs(got[s] / sum(got.values()) - f) < 0.002 for s, f in FRACTIONS.items())
    assert hand_plan([], FRACTIONS) == {} and set(hand_plan([(3, 0, 9)], FRACTIONS).values()) == {"train"}


@pytest.mark.parametrize("finish", [0, 40, 10**6])
def test_forest_is_the_least_one(spark, finish):
    from domainloom.llm.components import spanning_forest

    rng = np.random.default_rng(5)
    edges = [(f"n{int(a)}", f"n{int(b)}", int(w)) for a, b, w in zip(rng.integers(0, 300, 500), rng.integers(0, 300, 500), rng.integers(0, 6, 500))]
    df = spark.createDataFrame([*edges, (None, "n1", 0), ("n1", "n1", -9), edges[0]], "a string, b string, w bigint")
    forest, roots = spanning_forest(df, finish)
    up: dict[str, str] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = set()
    least: dict[tuple[str, str], int] = {}
    for a, b, w in edges:
        if a != b:
            least[min(a, b), max(a, b)] = min(w, least.get((min(a, b), max(a, b)), w))
    for (a, b), w in sorted(least.items(), key=lambda e: (e[1], e[0])):
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            want.add((a, b, w))
    assert {tuple(r) for r in forest.collect()} == want
    assert {r["node"]: r["root"] for r in roots.collect()} == {x: find(x) for x in up}


def test_divided(spark):
    df = records(spark, 600)
    rows = [(r["superfamily"], r["delivered"]) for r in df.collect()]
    by = defaultdict(set)
    for k, s in rows:
        if k is not None and s is not None:
            by[k].add(s)
    want = {k for k, s in by.items() if len(s) > 1}
    got = [r[0] for r in divided(assign_splits(df, ["superfamily", "domain"], FRACTIONS), "superfamily").collect()]
    assert len(got) == len(set(got)) and set(got) == want
