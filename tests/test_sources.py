from __future__ import annotations

import json

import numpy as np
import pytest
from domainloom.functions.ids import domain_of, header_token, report_number, split_of
from domainloom.sources import fasta, labels, sinks, store
from domainloom.sources.reports import in_force, parameter
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def test_headers(spark):
    given = [">cath|4_4_0|12e8H01/1-113", ">cath|4_4_0|12e8H01", ">AF-A0A3N5ZM32-F1-model_v4_TED03", ">foo_bar/1-100", ">sp|P1|NAME extra", "> spaced id", ">", None, ">a|b", ">a|b|c|d/1/2"]
    assert column(spark, given, header_token) == ["12e8H01", "12e8H01", "AF-A0A3N5ZM32-F1-model_v4_TED03", "foo_bar", "NAME", "spaced", "", None, "a|b", "c"]


def test_domains(spark):
    given = ["12E8H01", ">cath|4_4_0|12e8H01/1-113", "12e8h01", "AF-X-F1-model_v4_TED03", "AF-X-F1-model_v6_TED03", " mgx1_D2 ", None, "  ", "1abcd0x", "/1-2"]
    assert column(spark, given, domain_of) == ["12e8H01", "12e8H01", "12e8h01", "AF-X-F1-model_v_TED03", "AF-X-F1-model_v_TED03", "mgx1_D2", None, None, "1abcd0x", None]


def test_splits_and_numbers(spark):
    assert column(spark, [" Train", "dev", "TRN", "tst", "hold-out", "hold_out", "other", "", None], split_of) == ["train", "val", "train", "test", "holdout", "holdout", None, None, None]
    assert column(spark, ["1,234", " 0.8 ", "x", None, "1 000"], report_number) == [1234.0, 0.8, None, None, 1000.0]


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text)], "file string, pos bigint, line string")


def test_sequences(spark):
    text = ["stray", ">aaaA01", "MVL", "SPA-DK", "", "  >bbbB01\r", "WGKV\r", ">aaaA01", "WGK", ">empty", ">", "AAA", ">last", "X"]
    rows = {r["id"]: (r["sequence"], r["length"]) for r in fasta.sequences(lines(spark, text)).collect()}
    assert rows == {"aaaA01": ("MVLSPADK", 8), "bbbB01": ("WGKV", 4), "empty": ("", 0), "last": ("X", 1)}
    assert [r["id"] for r in fasta.header_ids(lines(spark, text)).orderBy("pos").collect()] == ["aaaA01", "aaaA01", "empty", "last"]
    assert fasta.sequences(lines(spark, text), first_wins=False).count() == 5
    assert fasta.sequences(lines(spark, ["no header"])).count() == 0


def test_sequence_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(fasta, "LINES_PER_CHUNK", 3)
    text = [">a"] + ["AB"] * 10 + [">b", "C"]
    rows = {r["id"]: r["sequence"] for r in fasta.sequences(lines(spark, text)).collect()}
    assert rows == {"a": "AB" * 10, "b": "C"}


def test_fasta_files(spark, tmp_path):
    (tmp_path / "b.fasta").write_bytes(b">x\r\nAA\r\n>y\r\nCC\r\n")
    (tmp_path / "a.fa").write_text(">x\nDD\n>z\nEE\n")
    assert list(fasta.resolve_paths(tmp_path)) == ["b", "a"]
    assert fasta.resolve_paths(tmp_path / "none") == {}
    with pytest.raises(FileNotFoundError):
        fasta.require_paths([tmp_path / "b.fasta", tmp_path / "none"])
    rows = {r["id"]: r["sequence"] for r in fasta.sequences(fasta.read_lines(spark, tmp_path)).collect()}
    assert rows == {"x": "AA", "y": "CC", "z": "EE"}
    again = {r["id"]: r["sequence"] for r in fasta.sequences(fasta.read_lines(spark, [tmp_path / "a.fa", tmp_path / "b.fasta"])).collect()}
    assert again["x"] == "DD"


def test_fasta_splits_keep_order(spark, tmp_path):
    body = "".join(f">id{i}\n" + "\n".join(chr(65 + (i + j) % 20) * (1 + j) for j in range(1 + i % 4)) + "\n" for i in range(500))
    (tmp_path / "x.fasta").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = {r["id"]: r["sequence"] for r in fasta.sequences(fasta.read_lines(spark, tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {f"id{i}": "".join(chr(65 + (i + j) % 20) * (1 + j) for j in range(1 + i % 4)) for i in range(500)}


def test_labels(spark):
    text = ["# comment", "a 1.1", "b\t2.2 extra", "short", "", None, "a 3.3", " # x"]
    df = spark.createDataFrame(list(enumerate(text)), "pos bigint, line string")
    assert {r["id"]: r["label"] for r in labels.label_table(df).collect()} == {"a": "3.3", "b": "2.2", "#": "x"}
    assert {r["label"]: r["label_idx"] for r in labels.label_vocabulary(df).collect()} == {"1.1": 0, "2.2": 1, "3.3": 2, "x": 3}


def test_superfamily(spark):
    recs = spark.createDataFrame([(1, "12E8H01", None, "old"), (2, None, None, "x"), (3, "q", 7, "x"), (4, "nolabel", None, None)], "row_id bigint, id string, label_idx bigint, domain string")
    text = spark.createDataFrame([(0, "12e8H01 A"), (1, "12E8H01 B"), (2, "nolabel C")], "pos bigint, line string")
    vocab = spark.createDataFrame([(5, "A"), (6, "B")], "label_idx bigint, label string")
    rows = {r["row_id"]: (r["domain"], r["superfamily"]) for r in labels.with_superfamily(recs, text, vocab).collect()}
    assert rows == {1: ("12e8H01", 6), 2: (None, None), 3: ("q", 7), 4: ("nolabel", None)}


def test_parameters(spark):
    import datetime as dt

    day = dt.datetime
    rows = [(1, day(2024, 1, 1), "s", "params", "x", "1"), (2, day(2024, 2, 1), "s", "params", "x", " 1,099 "), (2, day(2024, 2, 1), "s", "params", "x", " 1,099 "), (2, day(2024, 2, 1), "s", "params", "y", None)]
    df = spark.createDataFrame(rows, "run_id bigint, run_at timestamp, report string, section string, item string, val string")
    assert parameter(df, "x") == 1099.0 and parameter(df, "y", 3.0) == 3.0 and in_force(df).count() == 2
    with pytest.raises(ValueError):
        parameter(df, "z")


def make(spark, n=4, dim=6):
    return spark.createDataFrame([(i, f"d{i}", [float(i * dim + j) for j in range(dim)], i) for i in range(n)], "row_id bigint, id string, embedding array<float>, label_idx bigint")


def test_store_round_trip(spark, tmp_path):
    path = tmp_path / "s"
    store.write_store(make(spark), path, source="x", vocabulary={0: "a"})
    rows, about = store.read_store(spark, path, require_labels=True)
    assert [tuple(r) for r in rows.orderBy("row_id").collect()] == [tuple(r) for r in make(spark).collect()]
    assert about["count"] == 4 and store.vocabulary_of(path, about) == {0: "a"}
    with pytest.raises(FileExistsError):
        store.write_store(make(spark), path)
    store.write_store(make(spark, 2), path, overwrite=True)
    assert store.read_store(spark, path)[0].count() == 2


def test_store_checks(spark, tmp_path):
    with pytest.raises(ValueError):
        store.check(make(spark).withColumn("embedding", F.when(F.col("row_id") == 0, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))))
    with pytest.raises(ValueError):
        store.check(make(spark), {"num_embeddings": 3})
    with pytest.raises(ValueError):
        store.check(make(spark).drop("label_idx"), require_labels=True)
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "ids.txt").write_text("a\n")
    with pytest.raises(ValueError):
        store.resolve_store(spark, tmp_path / "part", lambda: make(spark))
    with pytest.raises(ValueError):
        store.resolve_store(spark, None)
    calls = []
    for _ in range(2):
        store.resolve_store(spark, tmp_path / "new", lambda: calls.append(1) or make(spark))
    assert calls == [1]


def test_import_arrays(spark, tmp_path):
    m = np.arange(24, dtype=np.float16).reshape(4, 6)
    np.save(tmp_path / "embeddings.npy", m)
    np.save(tmp_path / "labels.npy", np.arange(4))
    (tmp_path / "ids.txt").write_text("a\n\n b \nc\nd\n")
    with pytest.raises(FileNotFoundError):
        store.import_arrays(spark, tmp_path)
    about = {"n_embeddings": 4, "embedding_dim": 6, "dtype": "float16"}
    (tmp_path / "metadata.json").write_text(json.dumps(about))
    rows = store.import_arrays(spark, tmp_path, rows_per_part=3).orderBy("row_id").collect()
    assert [(r["id"], r["label_idx"], r["embedding"]) for r in rows] == [(i, k, m[k].astype(float).tolist()) for k, i in enumerate("abcd")]
    assert store.import_arrays(spark, f"file:{tmp_path}", require_labels=True).count() == 4
    for key, wrong in (("n_embeddings", 5), ("embedding_dim", 7), ("dtype", "float32")):
        (tmp_path / "metadata.json").write_text(json.dumps(about | {key: wrong}))
        with pytest.raises(ValueError, match="metadata says"):
            store.import_arrays(spark, tmp_path)
    (tmp_path / "metadata.json").write_text("{}")
    (tmp_path / "ids.txt").write_text("a\n")
    with pytest.raises(ValueError, match="ids"):
        store.import_arrays(spark, tmp_path)
    np.save(tmp_path / "labels.npy", np.arange(3))
    with pytest.raises(ValueError, match="labels"):
        store.import_arrays(spark, tmp_path)
    (tmp_path / "labels.npy").unlink()
    with pytest.raises(ValueError, match="labels"):
        store.import_arrays(spark, tmp_path, require_labels=True)


def test_row_map_override(spark):
    s = spark.createDataFrame([(0, "k", [1.0]), (1, "m", [2.0]), (2, "k", [3.0])], "row_id bigint, id string, embedding array<double>")
    ids = spark.createDataFrame([(0, "k"), (1, "m")], "query_pos bigint, id string")
    rows = lambda override: sorted((r["query_pos"], r["embedding"][0]) for r in store.gather(ids, s, override).collect())
    assert rows(None) == [(0, 3.0), (1, 2.0)]
    assert rows(spark.createDataFrame([("k", 0)], "id string, row_id bigint")) == [(0, 1.0)]


def test_uris_and_plain_paths_name_the_same_files(spark, tmp_path):
    folder = tmp_path / "two words+plus"
    folder.mkdir()
    for name, text in (("b.fasta", ">b1\nMK\n"), ("a.fa", ">a1\nGH\n>a2\n"), ("c.txt", ">no\n")):
        (folder / name).write_text(text)
    plain, uri = fasta.resolve_paths(folder), fasta.resolve_paths(f"file:{folder}")
    assert list(plain) == list(uri) == ["b", "a"] and uri["a"] == f"file:{plain['a']}"
    for source in (folder, f"file:{folder}", f"file://{folder}/", [f"file:{folder}/b.fasta", folder / "a.fa"]):
        got = [tuple(r) for r in fasta.sequences(fasta.read_lines(spark, source)).orderBy("id").select("id", "sequence", "file").collect()]
        assert got == [("a1", "GH", str(folder / "a.fa")), ("a2", "", str(folder / "a.fa")), ("b1", "MK", str(folder / "b.fasta"))]
    assert fasta.resolve_paths(f"file:{folder}/none") == {}
    at = f"file:{tmp_path}/store"
    store.write_store(make(spark), at, vocabulary={0: "x"})
    assert store.read_store(spark, tmp_path / "store")[1]["count"] == store.read_store(spark, at)[0].count()
    with pytest.raises(FileExistsError):
        store.write_store(make(spark), at)
    df = spark.createDataFrame([("q", None)], "a string, b string")
    assert (tmp_path / "sub" / "t.tsv").exists() is False
    sinks.write_tsv(df, f"file:{tmp_path}/sub/t.tsv")
    sinks.write_tsv(df, f"file:{tmp_path}/sub/t.tsv")
    assert (tmp_path / "sub" / "t.tsv").read_bytes() == b"a\tb\r\nq\t\r\n" and [p.name for p in (tmp_path / "sub").iterdir()] == ["t.tsv"]


def test_headers_are_inherited_over_chunks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(fasta, "LINES_PER_CHUNK", 3)
    monkeypatch.setattr(fasta, "CHUNKS_PER_GROUP", 2)
    body = [f"{'ACDEFGHIK'[i % 9]}" for i in range(60)]
    lines = [("f", i, f">s{i}" if i in (4, 5, 31) else body[i]) for i in range(60)] + [("g", i, ">g" if i == 0 else "W") for i in range(25)]
    got = {r["id"]: r["sequence"] for r in fasta.sequences(spark.createDataFrame(lines, "file string, pos bigint, line string")).collect()}
    assert got == {"s4": "", "s5": "".join(body[6:31]), "s31": "".join(body[32:]), "g": "W" * 24}


def test_vocabulary_sidecar(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"3": "x"}))
    assert store.vocabulary_of(tmp_path, {"idx_to_label_file": "v.json"}) == {3: "x"}
    assert store.vocabulary_of(tmp_path, {}) is None
    assert store.metadata_value({"embedding_dim": 5}, "dim") == 5 and store.metadata_value({}, "dim") is None


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("q1", "A", 0.1, 1.0), ("q2", "unknown", None, 0.0)], "query_id string, predicted_annotation string, distance double, confidence double")
    out = sinks.write_tsv(df.orderBy("query_id"), tmp_path / "p.tsv", sinks.prediction_columns(distance=True, confidence=True))
    assert open(out, "rb").read() == b"query_id\tpredicted_annotation\tdistance\tconfidence\r\nq1\tA\t0.1\t1.0\r\nq2\tunknown\t\t0.0\r\n"
    assert [p.name for p in tmp_path.iterdir()] == ["p.tsv"]
    bad = df.withColumn("distance", F.raise_error("stop").cast("double"))
    with pytest.raises(Exception):
        sinks.write_tsv(bad, tmp_path / "q.tsv")
    assert [p.name for p in tmp_path.iterdir()] == ["p.tsv"]
    assert open(sinks.write_metrics(df.limit(1), tmp_path / "m.json")).read().startswith("{\n  ")


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "x0", [3.0, 4.0]), (1, "x1", [0.0, 0.0])], "row_id bigint, id string, vec array<float>")
    lab = spark.createDataFrame([("x0", "A")], "id string, label string")
    sinks.write_index(sinks.build_index(rows, lab, half=True), tmp_path / "i")
    got = [(r["id"], r["label"], [round(x, 6) for x in r["vec"]]) for r in sinks.read_index(spark, tmp_path / "i").orderBy("row_id").collect()]
    assert got == [("x0", "A", [0.6, 0.8]), ("x1", "unknown", [0.0, 0.0])]
