from __future__ import annotations

import dataclasses
import json

import numpy as np
import pytest
from domainloom import train
from domainloom.config import AnnotateConfig, EmbedConfig, IndexConfig, override
from domainloom.operators.project import WEIGHTS, Head
from domainloom.sources import sinks


def numeric(f, a, at, eps=1e-6):
    keep = a[at]
    a[at] = keep + eps
    hi = f()
    a[at] = keep - eps
    lo = f()
    a[at] = keep
    return (hi - lo) / (2 * eps)


@pytest.mark.parametrize("loss", ["supcon", "proxy_anchor"])
def test_gradients(loss):
    rng = np.random.default_rng(0)
    head = Head.init(5, 7, 4, seed=3)
    x, y, proxies = rng.normal(size=(9, 5)), np.array([0, 0, 1, 1, 2, 2, 0, 1, 3]), rng.normal(size=(4, 4))

    def value():
        kept = head.mean.copy(), head.var.copy()
        e, cache = train.forward(head, x)
        head.mean[:], head.var[:] = kept
        return (*(train.supcon(e, y, 0.5) if loss == "supcon" else train.proxy_anchor(e, y, proxies, 0.1, 4.0)), cache)

    out = value()
    grads = train.backward(head, out[-1], out[1])
    for name, g in grads.items():
        a = getattr(head, name)
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(4)]:
            assert g[at] == pytest.approx(numeric(lambda: value()[0], a, at), abs=2e-5), name
    if loss == "proxy_anchor":
        # proxies are set to unit length first, so only the part of their gradient across them shows in the loss
        assert np.allclose(np.linalg.norm(proxies, axis=1), 1)
        across = out[2] - (out[2] * proxies).sum(axis=1, keepdims=True) * proxies
        for at in [(0, 1), (3, 2)]:
            kept = proxies.copy()
            found = []
            for eps in (1e-6, -1e-6):
                proxies[:] = kept
                proxies[at] += eps
                found.append(value()[0])
            proxies[:] = kept
            assert across[at] == pytest.approx((found[0] - found[1]) / 2e-6, abs=2e-5)


def test_clip_and_optimizer():
    g = {"a": np.array([3.0, 4.0])}
    train.clip(g, 1.0)
    assert np.allclose(g["a"], [0.6, 0.8])
    v = {"a": np.array([1.0])}
    train.AdamW(0.1).step(v, {"a": np.array([2.0])}, 0.01)
    assert v["a"][0] == pytest.approx(1 - 0.001 - 0.01, abs=1e-6)


def clusters(spark):
    rng = np.random.default_rng(17)
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0][:6]
    rows = [(1000 - i, f"chain{i}", [float(v) for v in 2 * centres[i % 6] + 0.2 * rng.normal(size=24)], 10 * (i % 6)) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id bigint, id string, embedding array<float>, label_idx bigint")
    return [df.where(f"row_id % 10 {part}") for part in ("< 7", "IN (7, 8)", "= 9")]


@pytest.mark.parametrize("loss", ["supcon", "proxy_anchor"])
def test_training_smoke(spark, tmp_path, loss):
    tr, va, te = clusters(spark)
    config = train.TrainConfig(hidden_dim=32, output_dim=16, loss=loss, max_epochs=2, warmup_epochs=1, batch_size=32)
    result = train.fit(tr, va, {"held": te}, config, tmp_path)
    assert len(result.history) == 2 and result.tests["held"] >= 0.8
    assert Head.load(tmp_path / "projection_head.npz").dims == (24, 32, 16)
    assert json.loads((tmp_path / "history.json").read_text())["tests"] == result.tests
    again = train.fit(tr, va, None, config)
    assert all(np.array_equal(getattr(again.head, k), getattr(result.head, k)) for k in WEIGHTS)


def test_training_limits(spark):
    tr, va, _ = clusters(spark)
    # sets beyond the bytes that may be held are read in parts: every row once an epoch, in another order
    parts = train.Vectors(tr, 8 * 24 * 20)
    assert parts.parts == 9 and parts.whole is None
    whole = train.Vectors(tr, 10**9).whole
    for epoch in (0, 1):
        pieces = list(parts.epoch(epoch))
        x, y = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        assert max(len(p[0]) for p in pieces) < len(x) and sorted(map(tuple, np.c_[x, y])) == sorted(map(tuple, np.c_[whole[0], whole[1]]))
    result = train.fit(tr, va, config=train.TrainConfig(hidden_dim=16, output_dim=8, max_epochs=2, warmup_epochs=1, batch_size=32, most_bytes=8 * 24 * 60))
    assert len(result.history) == 2 and result.history[-1]["val_accuracy"] > 0.8
    head = Head.init(24, 16, 8)
    assert train.nearest_accuracy(head, whole, train.Vectors(va, 10**9).whole) == pytest.approx(train.evaluate(head, tr, va))
    with pytest.raises(ValueError):
        train.split_rows(tr, spark.createDataFrame([("none",)], "id string"))


def test_overrides():
    c = override(AnnotateConfig(), ["k=5", "distance_cutoff=0.4", "compute_metrics=true", "label_file=null", "encode.max_batch=7", "input=x"])
    assert (c.k, c.distance_cutoff, c.compute_metrics, c.label_file, c.encode.max_batch, c.input) == (5, 0.4, True, None, 7, "x")
    assert override(IndexConfig(), ["ids=[a,b]"]).ids == ("a", "b")
    for bad in ("nope=1", "k", "compute_metrics=maybe"):
        with pytest.raises(ValueError):
            override(AnnotateConfig(), [bad])


def test_runs_end_to_end(spark, tmp_path):
    from domainloom import runs

    (tmp_path / "db.fasta").write_text(">x0\nACDEFGHIKL\n>x1\nMNPQRSTVWY\n>x2\nACDEFGHIKV\n")
    (tmp_path / "labels.txt").write_text("x0 A\nx1 B\nx2 A\nq0 A\nq1 C\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.fasta").write_text(">q0\nACDEFGHIKL\n>q1\nMNPQRSTVWW\n>q2\n\n>q0\nACD\n")
    runs.run_embed(spark, EmbedConfig(input=str(tmp_path / "db.fasta"), output_dir=str(tmp_path / "store"), label_file=str(tmp_path / "labels.txt")))
    index = runs.run_build_index(spark, IndexConfig(input=str(tmp_path / "db.fasta"), store=str(tmp_path / "store"), label_file=str(tmp_path / "labels.txt"), output=str(tmp_path / "index")))
    assert index.count() == 3
    config = AnnotateConfig(
        input=str(tmp_path / "in"), index=str(tmp_path / "index"), label_file=str(tmp_path / "labels.txt"), output_dir=str(tmp_path / "out"), k=2,
        return_true_annotation=True, return_confidence=True, compute_metrics=True, num_thresholds=12, single_file=True,
    )
    (tmp_path / "in" / "r.fa").write_text(">q1\nMNPQRSTVWY\n")
    out = runs.run_annotate(spark, config)
    lines = (tmp_path / "out" / "q_annotations.tsv").read_text().splitlines()
    assert lines[0].split("\t") == ["query_id", "predicted_annotation", "true_annotation", "distance", "confidence"]
    rows = [x.split("\t") for x in lines[1:]]
    assert (tmp_path / "out" / "r_annotations.tsv").read_text().splitlines()[1:][0].startswith("q1\tB\tC\t") and set(out) == {"q", "r"}
    parts = runs.run_annotate(spark, dataclasses.replace(config, output_dir=f"file:{tmp_path}/parts", single_file=False))
    kinds = "query_id string, predicted_annotation string, true_annotation string, distance double, confidence double"
    assert [r["query_id"] for r in sinks.read_tsv(spark, parts["q"], kinds).collect()] == [r[0] for r in rows]
    assert [(r[0], r[1], r[2]) for r in rows] == [("q1", "B", "C"), ("q2", "missing_embedding", "unknown"), ("q0", "A", "A"), ("q0", "A", "A")]
    assert json.loads((tmp_path / "out" / "q_metrics.json").read_text()) == {"evaluated": 3, "accuracy": pytest.approx(2 / 3)}
    assert len((tmp_path / "out" / "q_selective_curve.tsv").read_text().splitlines()) == 13
    found = runs.run_evaluate(spark, AnnotateConfig(store=str(tmp_path / "store"), index=str(tmp_path / "index"), label_file=str(tmp_path / "labels.txt")))
    assert found == {"evaluated": 3, "accuracy": 1.0}


def test_evaluation_on_the_driver_projects_in_steps():
    import tracemalloc

    rng = np.random.default_rng(4)
    head = Head.init(16, 512, 8, seed=1)
    x, q = rng.standard_normal((9000, 16)).astype(np.float32), rng.standard_normal((1500, 16)).astype(np.float32)
    x[7000:8000] = x[:1000]  # ties go to the first
    y, t = np.arange(9000) % 7, np.arange(1500) % 7
    tracemalloc.start()
    got = train.nearest_accuracy(head, (x, y), (q, t))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one layer of all rows alone would take 37 MB, and several are needed at once
    assert peak < 8 * len(x) * 512 * 2
    nearest = np.round(head.forward(q).astype(np.float32) @ head.forward(x).astype(np.float32).T, 6).argmax(axis=1)
    assert got == pytest.approx((y[nearest] == t).mean(), abs=2e-3)


def test_the_driver_holds_single_precision_within_its_room(spark, monkeypatch):
    tr, va, _ = clusters(spark)
    tr, va = (d.withColumn("embedding", d["embedding"].cast("array<float>")) for d in (tr, va))
    assert train.Vectors(tr, 10**9).whole[0].dtype == np.float32
    made = []
    init = train.Vectors.__init__
    monkeypatch.setattr(train.Vectors, "__init__", lambda self, *a: init(self, *a) or made.append(self.parts))
    monkeypatch.setattr(train, "driver_room", lambda _: 8 * 24 * 60)
    train.fit(tr, va, config=train.TrainConfig(hidden_dim=16, output_dim=8, max_epochs=1, warmup_epochs=1, batch_size=32))
    assert made[0] > 1


def test_stream(spark, tmp_path):
    from domainloom.streaming.annotate import annotate_stream

    src = tmp_path / "src"
    q = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", None)], "query_pos bigint, query_id string, vec array<double>")
    q.write.parquet(str(src))
    index = spark.createDataFrame([(0, "x", "A", [1.0, 0.0])], "row_id bigint, id string, label string, vec array<double>")
    stream = spark.readStream.schema(q.schema).parquet(str(src))
    annotate_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"), trigger_once=True).awaitTermination(120)
    got = {r["query_id"]: r["predicted_annotation"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "A", "b": "missing_embedding"}


def test_store_training_is_the_whole_run(spark, small, monkeypatch):
    from domainloom.plans import catalogue

    seen = {}

    def fit(rows, val, tests=None, config=train.TrainConfig(), out=None):
        seen.update(rows=rows.count(), val=val.count(), config=config)
        return train.Result(None, [{"epoch": 0, "train_loss": 0.0, "val_loss": 0.0, "val_accuracy": 0.0}])

    monkeypatch.setattr(train, "fit", fit)
    assert catalogue.queries()["train_head_store"](spark, small).count() == 1
    assert seen["config"] == train.TrainConfig() and seen["rows"] > seen["val"] > 0


@pytest.mark.parametrize("checkpoint", [True, False])
def test_train_run(spark, tmp_path, checkpoint):
    from domainloom import runs
    from domainloom.config import TrainRunConfig
    from domainloom.sources import store

    tr, va, te = clusters(spark)
    store.write_store(tr.union(va).union(te), tmp_path / "store")
    for name, rows in (("train", tr), ("val", va), ("test", te)):
        (tmp_path / f"{name}.fasta").write_text("".join(f">{r['id']}\nMK\n" for r in rows.select("id").collect()) + ">elsewhere\nMK\n")
    config = TrainRunConfig(
        store=str(tmp_path / "store"), train=str(tmp_path / "train.fasta"), val=str(tmp_path / "val.fasta"), test=str(tmp_path / "test.fasta"), output_dir=str(tmp_path / "out"),
        checkpoint_dir=str(tmp_path / "kept") if checkpoint else None, fit=train.TrainConfig(hidden_dim=16, output_dim=8, max_epochs=2, warmup_epochs=1, batch_size=32),
    )
    result = runs.run_train(spark, config)
    # the store names no classes, so they are named by their numbers
    assert result.classes == {10 * c: str(10 * c) for c in range(6)} and result.tests["test"] > 0.8
    assert (tmp_path / ("kept" if checkpoint else "out") / "projection_head.npz").exists() and (tmp_path / "out").exists() is not checkpoint


def test_single_precision_stays_single():
    rng = np.random.default_rng(0)
    head = Head.init(5, 7, 4, dropout=0.2, seed=3)
    x, y, proxies = rng.normal(size=(40, 5)), rng.integers(0, 6, 40), rng.normal(size=(6, 4))
    e, cache = train.forward(head, x, np.random.default_rng(1))
    double = train.proxy_anchor(e, y, proxies.copy(), 0.3, 32.0)
    wide = train.backward(head, cache, double[1])
    head = Head(*[getattr(Head.init(5, 7, 4, dropout=0.2, seed=3), k).astype(np.float32) for k in WEIGHTS], 0.2)
    e, cache = train.forward(head, x.astype(np.float32), np.random.default_rng(1))
    loss, ge, gp = train.proxy_anchor(e, y, proxies.astype(np.float32), 0.3, 32.0)
    grads = train.backward(head, cache, ge)
    train.clip(grads, 1e-3)
    train.AdamW(1e-4).step({k: getattr(head, k) for k in grads}, grads, train.learning_rate(train.TrainConfig(), 20))
    assert all(a.dtype == np.float32 for a in (e, ge, gp, *grads.values(), *(getattr(head, k) for k in WEIGHTS), head.forward(x.astype(np.float32))))
    assert loss == pytest.approx(double[0], rel=1e-4) and np.allclose(ge, double[1], rtol=1e-3, atol=1e-4) and np.allclose(gp, double[2], rtol=1e-3, atol=1e-4)
    grads = train.backward(Head(*[getattr(Head.init(5, 7, 4, dropout=0.2, seed=3), k).astype(np.float32) for k in WEIGHTS], 0.2), cache, ge)
    assert all(np.allclose(grads[k], wide[k], rtol=1e-2, atol=1e-3) for k in wide)


def test_stored_single_precision_is_trained_on_as_such(spark, monkeypatch):
    tr, va, _ = clusters(spark)
    tr, va = (d.withColumn("embedding", d["embedding"].cast("array<float>")) for d in (tr, va))
    seen = set()
    forward = train.forward
    monkeypatch.setattr(train, "forward", lambda head, x, *a: seen.add((head.w1.dtype, x.dtype, (out := forward(head, x, *a))[0].dtype)) or out)
    config = train.TrainConfig(hidden_dim=16, output_dim=8, max_epochs=2, warmup_epochs=1, batch_size=32)
    result = train.fit(tr, va, config=config)
    assert seen == {(np.dtype(np.float32),) * 3} and result.history[-1]["val_accuracy"] > 0.8 and result.head.w1.dtype == np.float64


def test_nearest_accuracy_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(4)
    head = Head.init(6, 8, 3, seed=1)
    x, q = rng.standard_normal((700, 6)), rng.standard_normal((300, 6))
    x[400:600] = x[:200]
    x[600:] = x[:100] + 1e-8
    y, t = np.arange(700), np.arange(300)
    place = np.round(head.forward(q).astype(np.float32) @ head.forward(x).astype(np.float32).T, 6).argmax(axis=1)
    for step in (64, 1024):
        # each query's label is the row that is its nearest, so every one is a hit
        assert train.nearest_accuracy(head, (x, y), (q, place), step) >= 0.99
        assert train.nearest_accuracy(head, (x, y), (q, (place + 400) % 700), step) <= 0.01
