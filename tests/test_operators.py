from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from domainloom.operators import annotate as ann
from domainloom.operators import encode, losses, metrics, project, structure, vectors
from domainloom.operators.knn import knn_join
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

VEC = "query_pos bigint, query_id string, vec array<double>"


def index_of(spark, rows, labels=None, ids=True):
    kinds, cols = "row_id bigint", []
    data = []
    for i, v in enumerate(rows):
        row = [i] + ([f"x{i}"] if ids else []) + ([labels[i]] if labels else []) + [[float(x) for x in v]]
        data.append(row)
    kinds += ", id string" * ids + ", label string" * bool(labels) + ", vec array<double>"
    return spark.createDataFrame(data, kinds)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(columns[0]).collect()]


# ---- search ---------------------------------------------------------------------------------------------------------


def test_every_direction_finds_itself(spark):
    rng = np.random.default_rng(21)
    basis = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    order = rng.permutation(7)
    q = spark.createDataFrame([(10 + i, f"chain{i}", [float(x) for x in basis[j] * (0.2 + 3 * i)]) for i, j in enumerate(order)], VEC)
    got = rows_of(knn_join(q, index_of(spark, basis), 1), "query_pos", "db_row", "similarity")
    assert got == [(10 + i, int(j), pytest.approx(1.0)) for i, j in enumerate(order)]


def test_the_grid_copies_rows_as_often_as_the_root_of_its_tasks():
    from domainloom.operators.knn import TASK_BYTES, grid

    for n, m in ((10**9, 10**9), (10**6, 10**9), (10**9, 10**5)):
        cuts, blocks = grid(n, m, 64, 4000)
        assert -(-n // cuts) * 64 * 8 <= TASK_BYTES + 512 and -(-m // blocks) * 64 * 8 <= TASK_BYTES + 512
        assert (n * blocks + m * cuts) / (n + m) <= 1.1 * max(1, (cuts * blocks) ** 0.5, 8000**0.5)
    assert grid(0, 0, 0, 8) == (1, 1) and grid(3, 2, 64, 8) == (3, 2)
    cuts, blocks = grid(2000, 2000, 64, 8)
    assert 16 <= cuts * blocks < 40


def test_strategies_agree_with_ties_and_zero_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5))
    rows = np.vstack([base, base[:7], np.zeros((2, 5)), base[3] * 2])
    index = index_of(spark, rows)
    q = index.select(F.col("row_id").alias("query_pos"), "vec").where("row_id % 3 = 0")
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    want = []
    for i in range(0, len(rows), 3):
        s = np.round(unit @ unit[i], 10)
        best = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-s[j], j))[:6]
        want += [(i, r + 1, j) for r, j in enumerate(best)]
    for strategy in ("expression", "block", "two_phase", "auto"):
        got = knn_join(q, index, 6, exclude_self=True, strategy=strategy, block_rows=9)
        assert sorted(tuple(r) for r in got.select("query_pos", "rank", "db_row").collect()) == sorted(want), strategy


@pytest.mark.parametrize("strategy", ["expression", "block", "two_phase"])
def test_small_and_empty_indexes(spark, strategy):
    index = index_of(spark, [[1, 0], [0, 1]])
    q = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", None)], VEC)
    assert rows_of(knn_join(q, index, 5, strategy=strategy), "rank", "db_row") == [(1, 0), (2, 1)]
    assert knn_join(q, index.limit(0), 5, strategy=strategy).count() == 0
    assert knn_join(q.limit(0), index, 5, strategy=strategy).count() == 0


# ---- vote -----------------------------------------------------------------------------------------------------------


def circle(*degrees):
    """Unit vectors in the plane."""
    return [[math.cos(math.radians(a)), math.sin(math.radians(a))] for a in degrees]


def test_the_nearest_three_decide(spark):
    index = index_of(spark, circle(0, 14, 21, 80, 95, 101, 180), ["barrel", "barrel", "sheet", "sheet", "helix", "helix", "coil"])
    q = spark.createDataFrame([(3, "p", circle(8)[0]), (5, "r", circle(97)[0]), (8, "none", None), (9, "s", circle(140)[0])], VEC)
    got = rows_of(ann.annotate(q, index, 3), "query_pos", "predicted_annotation", "confidence", "top1_db_row")
    third = pytest.approx(2 / 3)
    assert got == [(3, "barrel", third, 1), (5, "helix", third, 4), (8, "missing_embedding", None, -1), (9, "helix", third, 5)]


def test_cutoff_is_inclusive_and_gives_unknown(spark):
    index = index_of(spark, circle(60, 120, 180), ["near", "far", "far"])
    q = spark.createDataFrame([(4, "q", circle(0)[0])], VEC)
    exact = float(knn_join(q, index, 1).first()["distance"])
    assert exact == pytest.approx(0.5)
    columns = ("predicted_annotation", "confidence", "top1_db_row")
    assert rows_of(ann.annotate(q, index, 1, exact), *columns) == [("near", 1.0, 0)]
    assert rows_of(ann.annotate(q, index, 1, exact - 1e-6), *columns, "distance") == [("unknown", 0.0, 0, exact)]
    # two of three are beyond the cutoff and do not outvote the one within
    assert rows_of(ann.annotate(q, index, 3, 1.2), *columns) == [("near", pytest.approx(1 / 3), 0)]
    assert rows_of(ann.annotate(q, index, 3, 2.0), *columns) == [("far", pytest.approx(2 / 3), 0)]


def test_labels_from_ids_and_the_label_unknown(spark):
    q = spark.createDataFrame([(2, "q", circle(10)[0])], VEC)
    unlabelled = index_of(spark, circle(12, 40, 70, 200))
    lookup = spark.createDataFrame([("x1", "loop"), ("x2", "loop"), ("x3", "turn"), ("elsewhere", "turn")], "id string, label string")
    # the nearest has no label: it holds a place but no vote
    assert rows_of(ann.annotate(q, unlabelled, 3, labels=lookup), "predicted_annotation", "confidence", "top1_db_row") == [("loop", pytest.approx(2 / 3), 0)]
    assert rows_of(ann.annotate(q, unlabelled, 3, labels=lookup.limit(0)), "predicted_annotation", "confidence") == [("unknown", 0.0)]
    # a stored label "unknown" votes like any other
    named = index_of(spark, circle(12, 15, 300, 310, 320), ["turn", "unknown", "unknown", "unknown", "turn"])
    assert rows_of(ann.annotate(q, named, 5), "predicted_annotation", "confidence") == [("unknown", pytest.approx(3 / 5))]


@pytest.mark.parametrize("k", [2, 5, 9])
def test_requested_k_divides(spark, k):
    q = spark.createDataFrame([(7, "q", circle(33)[0])], VEC)
    short = index_of(spark, circle(30, 36), ["knot", "knot"])
    assert rows_of(ann.annotate(q, short, k), "predicted_annotation", "confidence") == [("knot", pytest.approx(2 / k))]
    assert rows_of(ann.annotate(q, short.limit(0), k), "predicted_annotation", "distance", "confidence", "top1_db_row") == [("unknown", None, 0.0, -1)]


def test_vote_against_a_plain_model(spark):
    rnd = random.Random(5)
    lists = [[(rnd.choice("ABC") if rnd.random() < 0.8 else None, rnd.random()) for _ in range(rnd.randint(1, 7))] for _ in range(300)]
    near, annotation, want = [], [], {}
    row = 0
    for q, items in enumerate(lists):
        items.sort(key=lambda x: x[1])
        for rank, (label, d) in enumerate(items, 1):
            near.append((q, rank, row, 1 - d, d))
            annotation.append((row, label))
            row += 1
        votes = [(label if d <= 0.7 else None) for label, d in items]
        counts = Counter(v for v in votes if v)
        if items[0][1] > 0.7 or not counts:
            want[q] = ("unknown", 0.0)
        else:
            best = max(counts.values())
            winner = next(v for v in votes if v and counts[v] == best)
            want[q] = (winner, best / 7)
    n = spark.createDataFrame(near, "query_pos bigint, rank int, db_row bigint, similarity double, distance double")
    a = spark.createDataFrame(annotation, "db_row bigint, annotation string")
    got = {r["query_pos"]: (r["predicted_annotation"], r["confidence"]) for r in ann.vote(n, a, 7, 0.7).collect()}
    assert got.keys() == want.keys()
    for q in want:
        assert got[q][0] == want[q][0] and got[q][1] == pytest.approx(want[q][1])


def test_truth_order_and_hits(spark):
    p = spark.createDataFrame([(0, "a", "A", 0), (1, "b", "unknown", 1), (2, "a", "A", 1), (3, None, "A", -1)], "query_pos bigint, query_id string, predicted_annotation string, top1_db_row bigint")
    lab = spark.createDataFrame([("a", "A")], "id string, label string")
    assert sorted(r["true_annotation"] for r in ann.attach_truth(p, lab).collect()) == ["A", "A", "unknown", "unknown"]
    assert rows_of(ann.in_query_order(p), "position", "query_pos") == [(0, 1), (1, 0), (2, 2), (3, 3)]
    assert rows_of(ann.top_hits(p, index_of(spark, np.eye(2))), "query_pos", "target_id") == [(0, "x0"), (2, "x1")]


def test_resolve(spark):
    rng = random.Random(8)
    names = [f"chain-{rng.randint(0, 25)}" for _ in range(60)]
    s = spark.createDataFrame(list(enumerate(names)), "row_id bigint, id string")
    asked = [rng.choice([f"chain-{rng.randint(0, 40)}", None]) if i % 6 == 0 else f"chain-{rng.randint(0, 40)}" for i in range(80)]
    last = {name: i for i, name in enumerate(names)}
    ids = spark.createDataFrame(list(enumerate(asked)), "query_pos bigint, id string")
    assert rows_of(ann.resolve(ids, s), "query_pos", "row_id") == [(i, last.get(a)) for i, a in enumerate(asked)]


def test_order_within_files(spark):
    p = spark.createDataFrame([(0, "b", "f1"), (1, "a", "f1"), (2, "b", "f1"), (3, "b", "f2"), (4, "c", "f2")], "query_pos bigint, query_id string, file string")
    got = {(r["file"], r["position"]): r["query_pos"] for r in ann.in_query_order(p, "file").collect()}
    assert got == {("f1", 0): 1, ("f1", 1): 0, ("f1", 2): 2, ("f2", 0): 3, ("f2", 1): 4}


# ---- metrics --------------------------------------------------------------------------------------------------------

PRED = "predicted_annotation string, true_annotation string, distance double, confidence double"


def test_summary_and_accuracy(spark):
    p = spark.createDataFrame([("X", "X", 0.1, 1.0), ("unknown", "X", 0.2, 0.0), ("missing_embedding", "X", None, None), ("Y", "unknown", 0.3, 0.5), ("Y", "", 0.3, 0.5), ("Y", None, 0.3, None)], PRED)
    r = metrics.summarize(p).first()
    assert (r["total"], r["annotated"], r["unknown"], r["missing"], r["confidences"]) == (6, 4, 1, 1, 3)
    assert tuple(metrics.annotation_accuracy(p).first()) == (2, 0.5)
    assert tuple(metrics.annotation_accuracy(p.limit(0)).first()) == (0, 0.0)
    by_pos = p.withColumn("query_pos", F.monotonically_increasing_id())
    assert sorted(r["confidence"] for r in metrics.confidences(by_pos).collect()) == [0.5, 0.5, 1.0]
    assert metrics.accuracy(p, "predicted_annotation", "true_annotation").first()[0] == pytest.approx(1 / 5)


def test_selective_curve(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["A", "unknown"]), rnd.choice(["A", "unknown", "B"]), round(rnd.random(), 2), 1.0) for _ in range(200)] + [("A", "A", None, None), ("A", "A", float("nan"), None), ("A", "", 9.0, 1.0)]
    rows = [(d, p == t) for p, t, d, _ in data if d is not None and not math.isnan(d) and t]
    lo, hi = min(d for d, _ in rows), max(d for d, _ in rows)
    for n in (1, 7, 50):
        got = [tuple(r) for r in metrics.selective_curve(spark.createDataFrame(data, PRED), n).orderBy("threshold").collect()]
        points = [hi if n > 1 and i == n - 1 else lo + i * (hi - lo) / max(n - 1, 1) for i in range(n)]
        want = []
        for t in points:
            inside = [ok for d, ok in rows if d <= t]
            want.append((t, len(inside) / len(rows), sum(inside) / len(inside) if inside else 0.0))
        assert got == [pytest.approx(w) for w in want]
    one = spark.createDataFrame([("A", "A", 0.5, 1.0)] * 3, PRED)
    assert {tuple(r) for r in metrics.selective_curve(one, 4).collect()} == {(0.5, 1.0, 1.0)}
    assert metrics.selective_curve(one.limit(0)).count() == 0


# ---- losses ---------------------------------------------------------------------------------------------------------


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def batch(spark, m, y):
    return spark.createDataFrame([(0, i, [float(x) for x in v], int(t)) for i, (v, t) in enumerate(zip(m, y))], "batch bigint, item bigint, vec array<double>, label int")


def test_supcon(spark):
    from domainloom.train import supcon

    m = unit(np.random.default_rng(0).normal(size=(16, 12)))
    for seed in range(3):
        y = np.random.default_rng(seed).integers(0, 9, 16) * 11
        got = losses.supcon_loss(batch(spark, m, y)).first()
        assert got["anchors"] == sum((y == t).sum() > 1 for t in y) and got["loss"] == pytest.approx(supcon(m, y, 0.07)[0]) and got["loss"] > 0
    scaled = losses.supcon_loss(batch(spark, m * np.arange(1, 17)[:, None], y), normalize=True).first()
    assert scaled["loss"] == pytest.approx(got["loss"])
    alone = losses.supcon_loss(batch(spark, m[:5], [40, 31, 22, 13, 4])).first()
    assert (alone["anchors"], alone["loss"]) == (0, 0.0)


def test_proxy_anchor(spark):
    from domainloom.train import proxy_anchor

    rng = np.random.default_rng(6)
    m, p, y = unit(rng.normal(size=(23, 8))), rng.normal(size=(11, 8)), rng.integers(0, 7, 23)
    proxies = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(p)], "label int, vec array<double>")
    want = proxy_anchor(m, y, p.copy(), 0.1, 32.0)[0]
    # in one block, and in several where there are more classes than one may hold
    for most in (100, 4, 1):
        got = losses.proxy_anchor_loss(batch(spark, m, y), proxies, most_proxies=most).first()
        assert got["present"] == len(set(y.tolist())) and got["loss"] == pytest.approx(want)


def test_learning_rates(spark):
    from domainloom.train import TrainConfig, learning_rate

    got = [r["learning_rate"] for r in losses.learning_rates(spark, 30, 0.003, 10).orderBy("epoch").collect()]
    assert got == pytest.approx([learning_rate(TrainConfig(max_epochs=30), e) for e in range(30)])
    assert got[0] == pytest.approx(3e-5) and got[10] == pytest.approx(0.003)


# ---- encoding and projection ----------------------------------------------------------------------------------------


def test_batches():
    sizes = lambda lengths, **k: list(Counter(encode.batches_of(lengths, **({"max_residues": 10**7, "max_batch": 999, "max_seq_len": 10**7} | k))).values())
    assert sizes([7] * 11, max_batch=4) == [4, 4, 3]
    assert sizes([30, 25, 20, 15, 10], max_residues=45) == [2, 3]
    assert sizes([900, 899, 12, 11], max_seq_len=898) == [1, 1, 2]
    assert sizes([]) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=60), st.integers(1, 5000), st.integers(1, 9), st.integers(1, 2000))
def test_batches_close_exactly_when_full(lengths, residues, items, longest):
    number = encode.batches_of(lengths, residues, items, longest)
    groups: dict[int, list[int]] = {}
    for b, n in zip(number, lengths):
        groups.setdefault(b, []).append(n)
    full = lambda g: len(g) >= items or sum(g) >= residues or g[-1] > longest
    assert list(groups) == list(range(len(groups)))
    for b, g in groups.items():
        assert not any(full(g[:i]) for i in range(1, len(g)))
        assert full(g) or b == len(groups) - 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80), st.integers(1, 90), st.integers(1, 9), st.integers(0, 30))
def test_runs_give_the_same_batches(lengths, residues, items, longest):
    lengths = sorted(lengths, reverse=True)
    config = encode.EncodeConfig(max_residues=residues, max_batch=items, max_seq_len=longest)
    got = []
    for length, batch, head, each in encode.batch_runs(sorted(Counter(lengths).items(), reverse=True), config):
        got += [batch if i < head else batch + 1 + (i - head) // each for i in range(lengths.count(length))]
    assert got == encode.batches_of(lengths, residues, items, longest)


def test_formatting_and_pooling(spark):
    df = spark.createDataFrame([(0, "AUZOC"), (1, "")], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(encode.tokenizable(F.col("s"))).collect()] == ["<AA2fold> A X X X C", "<AA2fold> "]
    t = spark.createDataFrame([(0, [[float(i)] * 4 for i in range(5)], 3), (1, [[0.0] * 4], 0)], "i int, t array<array<double>>, n int")
    assert [r[0] for r in t.orderBy("i").select(vectors.mean_pool(F.col("t"), F.col("n"))).collect()] == [[2.0] * 4, None]


def picky():
    # made here, so that it is sent by value
    class Picky(encode.KmerEncoder):
        """Refuses batches with a B, leaves out sequences that begin with W."""

        def encode(self, sequences):
            if any("B" in s for s in sequences.values()):
                raise RuntimeError("no B")
            return {i: v for i, v in super().encode(sequences).items() if not sequences[i].startswith("W")}

    return Picky


def test_encoder_failures_are_reported(spark):
    rows = [("f", i, f"s{i}", s, len(s)) for i, s in enumerate(["MKVLA", "MKBVLA", "", "MKVLA", "GH", "WWT"])]
    seqs = spark.createDataFrame(rows, "file string, pos bigint, id string, sequence string, length int").coalesce(1)
    whole = {r["id"]: r for r in encode.encode_all(seqs, picky(), encode.EncodeConfig(max_batch=1)).collect()}
    assert {i: r["failure"] for i, r in whole.items()} == {"s0": None, "s1": "RuntimeError: no B", "s2": "empty sequence", "s3": None, "s4": None, "s5": "left out by the encoder"}
    assert all((r["embedding"] is None) == (r["failure"] is not None) for r in whole.values())
    got = encode.as_store(encode.encode(seqs, picky(), encode.EncodeConfig(max_batch=1)))
    assert rows_of(got, "row_id", "id") == [(0, "s0"), (1, "s3"), (2, "s4")]
    first, other = got.where("id = 's0'").first()["embedding"], got.where("id = 's3'").first()["embedding"]
    assert first == other and abs(np.linalg.norm(first) - 1) < 1e-3
    known, missing = encode.with_labels(got, spark.createDataFrame([("s0", "A")], "id string, label string"))
    assert rows_of(known, "id") == [("s0",)] and rows_of(missing, "id") == [("s3",), ("s4",)]
    with pytest.raises(ValueError):
        encode.with_labels(got, spark.createDataFrame([], "id string, label string"))


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_survivors_do_not_depend_on_partitions(spark, parts):
    rnd = random.Random(3)
    config = encode.EncodeConfig(max_residues=60, max_batch=4, max_seq_len=30)
    rows = [(f"f{i % 2}", i, f"s{i}", "".join(rnd.choice("ACDEF" + "B" * (i % 9 == 0)) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    lost = set()
    for file in ("f0", "f1"):
        mine = sorted((r for r in rows if r[0] == file and r[3]), key=lambda r: (-len(r[3]), r[1]))
        number = encode.batches_of([len(r[3]) for r in mine], 60, 4, 30)
        bad = {b for b, r in zip(number, mine) if "B" in r[3]}
        lost |= {r[2] for b, r in zip(number, mine) if b in bad} | {r[2] for r in rows if r[0] == file and not r[3]}
    df = spark.createDataFrame([(*r, len(r[3])) for r in rows], "file string, pos bigint, id string, sequence string, length int").repartition(parts)
    assert {r["id"] for r in encode.encode(df, picky(), config).collect()} == {r[2] for r in rows} - lost


def test_half_precision(spark):
    rows = [(0, [0.1, 70000.0, -1e-8]), (1, None), (2, []), (3, [2.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = dict(rows_of(df.select("i", vectors.half_precision(F.col("v")).alias("h")), "i", "h"))
    assert got == {0: [float(np.float16(0.1)), float("inf"), -0.0], 1: None, 2: [], 3: [2.0]}


def test_head(spark, tmp_path):
    head = project.Head.init(8, 6, 4, 0.1, seed=1)
    head.mean[:], head.var[:] = 0.3, 2.0
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = (x @ head.w1.T + head.b1 - head.mean) / np.sqrt(head.var + project.BN_EPS)
    g = 0.5 * h * (1 + np.vectorize(math.erf)(h / math.sqrt(2)))
    y = g @ head.w2.T + head.b2
    want = y / np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose(head.forward(x), want, atol=1e-6)
    again = project.Head.load(head.save(tmp_path / "h.npz"))
    assert again.dims == (8, 6, 4) and again.dropout == 0.1 and np.array_equal(again.forward(x), head.forward(x))
    np.savez(tmp_path / "c.npz", **{f"projection_head.{k}": getattr(head, k) for k in project.WEIGHTS})
    assert np.allclose(project.Head.load(tmp_path / "c.npz").forward(x), head.forward(x))
    np.savez(tmp_path / "bad.npz", other=x)
    with pytest.raises(ValueError):
        project.Head.load(tmp_path / "bad.npz")
    rows = [(i, [float(v) for v in r], "keep") for i, r in enumerate(x)] + [(5, None, "n"), (6, [1.0], "short"), (7, [float("nan")] * 8, "nan")]
    df = spark.createDataFrame(rows, "row_id bigint, embedding array<double>, vec string")
    assert project.Head.load(f"file:{tmp_path}/h.npz").dims == (8, 6, 4)
    got = {r["row_id"]: r["vec"] for r in project.project(df, head, batch_size=2).collect()}
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-5) and [got[i] for i in (5, 6, 7)] == [None] * 3


# ---- structure ------------------------------------------------------------------------------------------------------

REPORT = (
    "Length of Chain_1:  120 residues\nLength of Chain_2:   75 residues\nAligned length= 90, RMSD=   2.50, Seq_ID=0.1\n"
    "TM-score= 0.33333 (if normalized by length of Chain_2, i.e.)\nTM-score= 0.71234 (if normalized by length of Chain_1, i.e.)\n"
)


def test_reports(spark):
    assert structure.parse_text(REPORT) == (0.71234, 2.5, 0.75)
    with pytest.raises(ValueError):
        structure.parse_text(REPORT.replace("RMSD", "?"))
    apart = REPORT.replace("Aligned length= 90, RMSD", "Aligned length= 90\nRMSD").replace("120 residues", "120")
    with pytest.raises(ValueError):
        structure.parse_text(apart)
    df = spark.createDataFrame([(0, REPORT), (1, "x"), (2, REPORT.replace("120", "0")), (3, None), (4, apart)], "i int, t string")
    parts = structure.parse_report(F.col("t"))
    got = [tuple(r) for r in df.orderBy("i").select(parts["tm_score"], parts["aligned_length"], parts["coverage"]).collect()]
    assert got == [(0.71234, 90, 0.75), (None, None, None), (0.71234, 90, 0.0), (None, None, None), (None, None, None)]


def test_structural_scores(spark, tmp_path):
    folder = tmp_path / "pdb"
    folder.mkdir()
    for name in ("q1.pdb", "q1.cif", "q2.cif.gz", "x0.ent", "x1.txt", "q3.pdb"):
        (folder / name).write_text("")
    tool = tmp_path / "aligner"
    tool.write_text("#!/bin/sh\ncase $1 in *q2*) exit 3;; *q3*) sleep 5;; esac\ncat <<'X'\n" + REPORT + "X\n")
    tool.chmod(0o755)
    files = structure.structure_files(spark, folder)
    best = dict(rows_of(structure.preferred(files), "id", "path"))
    assert best["q1"].endswith("q1.pdb") and set(best) == {"q1", "q2", "q3", "x0"}
    p = spark.createDataFrame([(1, "q1", "A", 0), (2, "q2", "A", 0), (3, "q3", "A", 0), (4, "q1", "unknown", 0), (5, "q1", "A", 1)], "query_pos bigint, query_id string, predicted_annotation string, top1_db_row bigint")
    got = rows_of(structure.attach_scores(p, index_of(spark, np.eye(2)), files, str(tool), timeout=1), "query_pos", "tm_score", "rmsd", "tm_coverage")
    assert got == [(1, 0.71234, 2.5, 0.75)] + [(i, None, None, None) for i in (2, 3, 4, 5)]
    pairs = structure.resolvable(ann.top_hits(p, index_of(spark, np.eye(2))), files)
    why = dict(rows_of(structure.score_structures(pairs, str(tool), 1), "query_pos", "failure"))
    assert why == {1: None, 2: "exit 3", 3: "timeout"}
    with pytest.raises(FileNotFoundError):
        structure.find_binary("no-such-aligner")
