from __future__ import annotations

import numpy as np
import pandas as pd
from domainloom.operators.skew import chunked_by_key, number_rows, superfamily_profiles
from pyspark.sql import functions as F


def test_numbers_are_dense_per_key(spark):
    rows = [(i, ["hot", "a", None][0 if i % 3 else (1 if i % 2 else 2)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "i bigint, k string").repartition(7, "i")
    got = number_rows(df, "k", "n").toPandas()
    assert len(got) == 3000 and list(got.columns) == ["i", "k", "n"]
    for _, g in got.groupby("k", dropna=False):
        assert sorted(g["n"]) == list(range(len(g)))


def test_numbers_follow_partition_order_and_replace_the_column(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("k"), F.lit("x").alias("n")).repartitionByRange(5, "id").sortWithinPartitions("id")
    got = {r["id"]: r["n"] for r in number_rows(df, "k", "n").collect()}
    assert got == {i: i // 2 for i in range(100)}


def _wide_rows(seed: int, n: int) -> list[tuple]:
    """Rows of nullable keys and values near and beyond 2^53, many of them neighbours that a double cannot tell apart."""
    rng = np.random.default_rng(seed)
    pool = [None, 0, -1, 2**53, 2**53 + 1, 2**60 + 3, 2**60 + 4, 2**63 - 1, -(2**63)]
    pick = lambda: pool[rng.integers(len(pool))]
    return [(i, pick(), pick()) for i in range(n)]


def test_large_integers_beside_nulls_stay_as_they_are(spark):
    for seed, parts in ((1, 1), (2, 3), (3, 8)):
        rows = _wide_rows(seed, 400)
        df = spark.createDataFrame(rows, "i bigint, k bigint, v bigint").repartition(parts)
        got = [tuple(r) for r in number_rows(df, "k", "n").collect()]
        assert sorted(r[0] for r in got) == list(range(400))
        assert {r[0]: r[1:3] for r in got} == {i: (k, v) for i, k, v in rows}
        for key in {r[1] for r in rows}:
            assert sorted(r[3] for r in got if r[1] == key) == list(range(sum(r[1] == key for r in rows)))


def test_every_type_passes(spark):
    import datetime
    import decimal

    rows = [(float("nan"), b"\x00", datetime.datetime(2024, 1, 2, 3, 4, 5, 6), datetime.date(1, 1, 1), decimal.Decimal("12345678901234567890.12"), [2**60 + 1, None], {"a": 2**61 + 1}, (None, True), "x"),
            (None, None, None, None, None, None, None, None, None), (float("nan"), b"", None, None, None, [], {}, (2**62 + 1, None), "")]
    kinds = "d double, b binary, t timestamp, day date, m decimal(22,2), a array<bigint>, p map<string,bigint>, s struct<x:bigint,y:boolean>, c string"
    df = spark.createDataFrame(rows, kinds).coalesce(1)
    for key in ("d", "c", "b", "t", "m"):
        got = number_rows(df, key, "n")
        assert [repr(tuple(r)) for r in got.drop("n").collect()] == [repr(tuple(r)) for r in df.collect()]
    assert [r["n"] for r in number_rows(df, "d", "n").collect()] == [0, 0, 1]


def test_large_keys_are_chunked_apart(spark):
    rows = [(k, i) for i in range(60) for k in (None, 2**60 + 3, 2**60 + 4)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(4)
    count = lambda p, g: pd.DataFrame({"n": np.bincount(g)})
    add = lambda p, g: pd.DataFrame({"n": np.bincount(g, p["n"]).astype(int)})
    got = {r["k"]: r["n"] for r in chunked_by_key(df, "k", count, add, "n bigint", chunk_rows=7, fan_in=2).collect()}
    assert got == {None: 60, 2**60 + 3: 60, 2**60 + 4: 60}


def test_without_broadcast(spark, monkeypatch):
    from domainloom.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_OFFSETS", 0)
    got = number_rows(spark.range(50).withColumn("k", F.lit(1)), "k", "n").toPandas()
    assert sorted(got["n"]) == list(range(50))


def test_chunks_merge_in_order(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("v")).repartitionByRange(4, "v").sortWithinPartitions("v")


    def states(p, piece):
        g = p["v"].groupby(piece)
        return pd.DataFrame({"first": g.first(), "last": g.last(), "n": g.size(), "chunks": 1})


    def merge(p, group):
        for _, g in p.groupby(group):
            assert list(g["first"]) == sorted(g["first"])
        g = p.groupby(group)
        return pd.DataFrame({"first": g["first"].first(), "last": g["last"].last(), "n": g["n"].sum(), "chunks": g["chunks"].sum()})

    got = {r["k"]: tuple(r)[1:] for r in chunked_by_key(df, "k", states, merge, "first bigint, last bigint, n bigint, chunks bigint", chunk_rows=50, fan_in=3).collect()}
    assert {k: v[:3] for k, v in got.items()} == {1: (0, 999, 334), 0: (1, 998, 666)} and got[1][3] >= 7 and got[0][3] >= 14


def test_profiles(spark):
    nan = float("nan")
    rows = [(1, "s", [1.0, 2.0]), (1, "t", [3.0, 4.0]), (1, None, None), (1, "s", [nan, 1.0]), (1, "s", [0.0, 0.0]), (1, "s", [1.0]), (2, None, None), (None, "s", [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "superfamily bigint, source string, embedding array<float>, records int")
    for size in (1, 2, 100):
        got = {r["superfamily"]: tuple(r)[1:] for r in superfamily_profiles(df, chunk_rows=size, dim=2).collect()}
        assert got == {1: (6, 2, 2, [2.0, 3.0]), 2: (1, 0, 0, None)}
    assert superfamily_profiles(df.limit(0), dim=2).count() == 0


def test_profiles_of_a_hot_key(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(500, 3)).astype(np.float32)
    df = spark.createDataFrame([(0 if i % 10 else i, f"s{i % 5}", [float(x) for x in m[i]]) for i in range(500)], "superfamily bigint, source string, embedding array<float>").repartition(6)
    got = {r["superfamily"]: r for r in superfamily_profiles(df, chunk_rows=32, dim=3).collect()}
    hot = [i for i in range(500) if i % 10 or i == 0]
    assert got[0]["records"] == len(hot) and np.allclose(got[0]["mean"], m[hot].astype(float).mean(axis=0))
