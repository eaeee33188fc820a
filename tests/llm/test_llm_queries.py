"""The training-data queries against their SQL or brute force on the smallest tables."""

from __future__ import annotations

import pytest
from domainloom.llm import queries as llm

from oracle import compare, connect


def _once(rows, table, key) -> bool:
    """Whether each ``key`` of the table stands in exactly one row."""
    ids = [r[key] for r in rows]
    return len(ids) == len(set(ids)) == table.select(key).distinct().count()


def _packed(rows, documents) -> bool:
    sizes = {r["doc_id"]: len(r["ids"]) for r in llm.p6_ids(documents.sparkSession, FOLDER[0]).collect()}
    parts: dict = {}
    for r in rows:
        parts.setdefault((r["capacity_name"], r["doc_id"]), []).append((r["start"], r["tokens"]))
    names = {name for name, _ in parts}
    whole = all(sum(n for _, n in found) == sizes[doc] and all(sum(n for _, n in sorted(found)[:i]) == start for i, (start, _) in enumerate(sorted(found))) for (_, doc), found in parts.items())
    return whole and len(parts) == len(names) * len(sizes) and len(names) == 3


FOLDER: list[str] = []
#: What must hold of the results of queries that have no SQL.
CHECKS = {
    "p2_splits": lambda rows, t: _once(rows, t("embedding_store"), "row_id") and {r["assigned"] for r in rows} <= {"train", "val", "test"},
    "p2_forest": lambda rows, t: len({(r["a"], r["b"]) for r in rows}) == len(rows) > 0 and all(r["a"] < r["b"] and r["w"] < 0 for r in rows),
    "p4_recall": lambda rows, t: len(rows) == 1 and rows[0]["recall"] >= 0.99 and rows[0]["full_recall"] >= 0.99,
    "p6_ids": lambda rows, t: _once(rows, t("documents"), "doc_id") and {r["doc_id"] for r in rows if not r["ids"]} == {r["doc_id"] for r in t("documents").where("text IS NULL OR text = ''").collect()},
    "p6_roundtrip": lambda rows, t: sum(r["documents"] for r in rows) == t("documents").count() and not any(r["differing"] for r in rows),
    "p7_packed": lambda rows, t: _packed(rows, t("documents")),
    "p7_fill": lambda rows, t: len(rows) == 3 and all(r["filled"] > 0.9 and r["containers"] >= r["least"] for r in rows),
    "p8_found": lambda rows, t: 0 < len({r["doc_id"] for r in rows}) == len(rows) < t("documents").count() / 4,
    "p8_assessed": lambda rows, t: _once(rows, t("documents"), "doc_id") and all(r["candidate"] or not r["spam"] for r in rows),
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, small, name):
    query, sql = llm.queries()[name], llm.oracle_sql().get(name)
    if sql is None:
        FOLDER[:] = [small]
        assert CHECKS[name](query(spark, small).collect(), lambda table: spark.read.parquet(f"{small}/{table}.parquet"))
    else:
        assert compare(spark, connect(small), query, sql, small) == ""


def test_recall_and_quality(spark, medium):
    q = llm.queries()
    recall = q["p4_recall"](spark, medium).first()
    assert recall["recall"] >= 0.99
    assert all(r["differing"] == 0 for r in q["p6_roundtrip"](spark, medium).collect())
    assert all(r["filled"] > 0.97 and r["containers"] >= r["least"] for r in q["p7_fill"](spark, medium).collect())
    shares = {r["assigned"]: r["count"] for r in q["p2_splits"](spark, medium).groupBy("assigned").count().collect()}
    total = sum(shares.values())
    assert abs(shares["train"] / total - 0.8) < 0.01 and abs(shares["val"] / total - 0.1) < 0.01


def test_every_row_has_its_five_nearest(spark, medium):
    recall = llm.queries()["p4_recall"](spark, medium).first()
    assert recall["full_neighbours"] > recall["true_neighbours"] and recall["full_recall"] == 1.0


def test_forest_spans_the_components(spark, small):
    q = llm.queries()
    edges = [(r["a"], r["b"]) for r in q["p2_forest"](spark, small).collect()]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert find(a) != find(b)
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert edges
    for r in q["p2_splits"](spark, small).where("label_idx IS NOT NULL").collect():
        assert find(f"superfamily:{r['label_idx']}") == r["root"]


def test_copies_share_a_class(spark, medium):
    groups = llm.queries()["p1_groups"](spark, medium)
    pairs = llm.queries()["p1_found"](spark, medium)
    g = groups.select("row_id", "group")
    a = pairs.join(g.withColumnRenamed("row_id", "row_id_a").withColumnRenamed("group", "ga"), "row_id_a")
    both = a.join(g.withColumnRenamed("row_id", "row_id_b").withColumnRenamed("group", "gb"), "row_id_b")
    assert both.where("ga <> gb").count() == 0 and both.count() == pairs.count()
    in_pairs = pairs.select("row_id_a").union(pairs.select("row_id_b")).distinct().count()
    assert groups.where("links > 0").count() == in_pairs
