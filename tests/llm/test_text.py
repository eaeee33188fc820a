"""Encoding, packing and spam."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import partial
from pathlib import Path

import numpy as np
import pytest
from domainloom.llm import packing, spam, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

VOCAB = str(Path(tokens.VOCAB_DIR) / tokens.RANK_FILE)
needs_vocab = pytest.mark.skipif(not Path(VOCAB).exists(), reason="no vocabulary files here")

TEXTS = ["", None, " ", "Hello world", "don't  stop\n\n\tnow ", "naïve café — αβγ 结构预测 🧬", "<|endoftext|>", "é é ﬁ ﻿​", "\r\n" * 3, "a" * 3000, "1234567890" * 5, "  leading", "trailing  ", "\x00\x01"]


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(VOCAB)


@needs_vocab
def test_ids_and_bytes(spark, enc):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, "Hello world", 8)], "doc_id bigint, text string, ids int")
    rows = tokens.encode_corpus(df).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]]
        assert r["ids"] == (enc.bpe.encode_ordinary(text) if text else []) and enc.decode(r["ids"]) == (text or "")
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert max((i for r in rows for i in r["ids"]), default=0) < 50256


@needs_vocab
def test_same_ids_as_the_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(str(Path(tokens.VOCAB_DIR) / "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in TEXTS:
        if t:
            assert enc.encode(t) == other.encode(t, add_special_tokens=False).ids


@needs_vocab
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'st 1.,\n\t 　é结^"), st.characters(exclude_categories=["Cs"])), max_size=200))
def test_cutting_changes_nothing(text):
    short = tokens.Encoder.__new__(tokens.Encoder)
    short.__dict__ |= tokens.encoder(VOCAB).__dict__ | {"piece_chars": 7}
    assert short.encode(text) == tokens.encoder(VOCAB).encode(text)
    assert "".join(short.pieces(text)) == text
    assert short.decode(short.encode(text)) == text


@needs_vocab
def test_very_long_texts(enc):
    for text in (" " * 1_500_000, "x " * 200_000, "ACDE" * 60_000, "^" * 300_000, " \n" * 400_000 + "end"):
        assert enc.decode(enc.encode(text)) == text


def check(plan, histogram, capacity):
    fill, seen = Counter(), defaultdict(list)
    for length, start, items, each, first in plan.rows:
        seen[length].append((start, items))
        for i in range(items):
            fill[first + i // each] += length
    assert all(v <= capacity for v in fill.values()) and len(fill) == plan.containers
    for length, n in histogram.items():
        at = 0
        for start, items in sorted(seen[length]):
            assert start == at
            at += items
        assert at == n
    return sum(k * v for k, v in histogram.items())


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30), st.integers(1, 70))
def test_plans_are_packings(histogram, groups):
    plan = packing.plan(histogram, 60, groups)
    total = check(plan, histogram, 60)
    assert plan.containers >= -(-total // 60)


def test_plans_are_tight():
    histogram = {31: 1000, 29: 1000, 20: 900, 40: 900, 7: 300, 3: 50}
    plan = packing.plan(histogram, 60)
    assert check(plan, histogram, 60) / (plan.containers * 60) > 0.98
    big = {n: 10**9 for n in range(1, 513)}
    assert len(packing.plan(big, 512).rows) < 5000
    with pytest.raises(ValueError):
        packing.plan({61: 1}, 60)
    assert packing.plan({}, 60).containers == 0


def test_large_capacities_are_planned_in_coarser_units():
    rng = np.random.default_rng(2)
    capacity = 100_003
    histogram = {int(n): int(k) for n, k in zip(rng.integers(1, capacity + 1, 300), rng.integers(1, 9, 300))} | {capacity - 1: 3}
    plan = packing.plan(histogram, capacity)
    assert check(plan, histogram, capacity) / (plan.containers * capacity) > 0.9 and plan.gap < 0.01
    sizes, demand = np.array([20, 31, 40]), np.array([900.0, 1000.0, 900.0])
    assert packing.configurations(sizes, demand, 60)[1] <= 2e-4 < packing.configurations(sizes, demand, 60, rounds=1)[1]


def test_ids_of_any_size_and_none(spark):
    rows = [(2**60 + 3, 5), (None, 4), (2**60 + 4, 5)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), {"c": 10}).collect()
    assert sorted(((r["doc_id"], r["tokens"]) for r in got), key=str) == sorted(rows, key=str)


def test_pack(spark):
    lengths = [0, None, 1, 10, 10, 25, 7, 7, 7, 3, 20, 21, 1] * 20
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(lengths)] + [(3, 10, "x")], "doc_id bigint, tokens bigint, piece string").repartition(5)
    caps = {"small": 10, "big": 32}
    rows = packing.pack(df, caps).collect()
    for name, cap in caps.items():
        mine = [r for r in rows if r["capacity_name"] == name]
        fill = Counter()
        for r in mine:
            fill[r["container"]] += r["tokens"]
        assert max(fill.values()) <= cap
        pieces = defaultdict(list)
        for r in mine:
            pieces[r["doc_id"]].append((r["piece"], r["start"], r["tokens"]))
        for i, n in enumerate(lengths):
            n = n or 0
            want = [(k, k * cap, min(cap, n - k * cap)) for k in range(max(1, -(-n // cap)))]
            assert sorted(pieces[i]) == sorted(want * (2 if i == 3 else 1))
    report = {r["capacity_name"]: r for r in packing.fill_report(packing.pack(df, caps), caps).collect()}
    assert report["big"]["containers"] >= report["big"]["least"] and report["big"]["filled"] > 0.9
    assert packing.pack(df.limit(0), caps).count() == 0


LEXICON = {w: (lang,) for lang, words in spam.FUNCTION_WORDS.items() for w in words.split()}
PROSE = "We compared the two families because the search had produced a result that is hard to explain. "
SPAM = {
    "keywords": "buy kinase cheap kinase online kinase free shipping kinase buy synthase cheap kinase bulk kinase order now kinase",
    "pseudo": "kinase with kinase, kinase for kinase. our kinase is the buy kinase. if you want kinase then kinase online is kinase.",
    "links": "\n".join(f"* Kinase {i}: https://shop.example/item{i}" for i in range(8)),
    "anchors": "\n".join(f'<a href="http://shop.example/{i}">Kinase Deals</a>' for i in range(8)),
    "tags": "#kinase #buy #kinase #cheap #synthase #kinase #online #kinase",
    "catalogue": "\n".join(f"AB-{1000 + i} kinase pure {i} mg €{i}.50" for i in range(8)),
    "dashes": "\n".join(f"AB\u2011{1000 + i} kinase pure {i} mg €{i}.50" for i in range(8)),
    "soup": "SEQUENCE FAMILY ARCHAEON SEQUENCE ACTIVE SITE HELIX BUNDLE FAMILY HELIX BUNDLE ACTIVE SITE MODEL SOLENOID RECEPTOR ALIGNMENT",
    "crumbs": "\n".join("Home > Kinase > Lyase > Shop" for _ in range(6)),
    "hidden": " ".join("k​i​n​a​s​e buy k1n@s3 cheap KINASE".split() * 5),
}
FINE = {
    "prose": PROSE * 3,
    "sequence": ">x/1-20\n" + "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL\n" * 4,
    "table": "\n".join(f"1abcA0{i}\t1.10.10.{i}\t5-{90 + i}" for i in range(9)),
    "glossary": "Glossary\nbarrel: " + PROSE + "\nfold: " + PROSE,
    "release": "Release 4_4_0\n- " + PROSE + "\n- " + PROSE,
    "code": PROSE + "\n\nfor q in queries:\n\tif q.distance > 0.9:\n\t\tcontinue\n\n" + PROSE,
    "one topic": "When the lyase domain is removed, the search reports a tie. Nobody had expected the lyase to bind zinc. A second lyase from a plant behaves in the same way. " * 4,
    "chinese": "结构域含有429个残基，属于超家族。重新计算后，约19%的序列改变了类别。" * 3,
    "german": "Die Domäne umfasst 177 Reste und gehört zur Superfamilie. Der Abstand zum nächsten Nachbarn ist klein, weshalb die Zuordnung als sicher gilt. " * 2,
}


IT = "Il dominio si trova vicino alla fine della catena e non lega lo zinco, ma il secondo sito è ancora attivo. Dopo la prima prova abbiamo visto che la ricerca non dà un esito sicuro per le classi più piccole. "
PL = "Nie wiadomo, czy ta domena wiąże cynk, ale po tej próbie widać, że drugi jej koniec jest dość luźny i nie ma go w bazie. Od lat nikt z nas nie był w stanie tego dobrze wyjaśnić. "
RU = "Мы не знали, что этот домен так близко к концу цепи, но он всё же не мешает ей. После того как мы ещё раз его нашли, стало ясно, что дело не в нём, а в том, как мы шли до него. "
#: Forms that no feature was made for; what is spam among them, and what is not.
OTHER_SPAM = {
    "bare links": "\n".join(f"proteine{i}-angebot.de laufband{i}.io" for i in range(12)),
    "german stuffing": "Laufschuhe günstig, Laufschuhe kaufen, Laufschuhe Angebot, Laufschuhe Test, Laufschuhe Rabatt, günstig Laufschuhe, Rabatt Laufschuhe, Angebot Laufschuhe " * 3,
    "italian stuffing": "Scarpe economiche online. Migliori scarpe economiche. Offerta scarpe economiche. Comprare scarpe economiche. Scarpe economiche scontate. Negozio scarpe economiche. " * 2,
    "labels": "\n".join(f"[{w} Rabatt](https://laden{i}.de/x) | [{w} Test](https://laden{i}.de/y)" for i, w in enumerate("Schuhe Hosen Jacken Taschen Uhren Ketten Ringe Brillen".split())),
    "yen catalogue": "\n".join(f"QX{i}77 espresso grinder steel ¥{i}900 | QX{i}78 espresso grinder brass ¥{i}800" for i in range(9)),
}
OTHER_FINE = {
    "column header": "sample, organism, chain, start, end, length, resolution, method, release, curator, comment, status, checksum",
    "repeated english": PROSE * 4,
    "italian": IT * 4, "polish": PL * 4, "russian": RU * 4,
    "code": "def best(rows, k):\n    order = sorted(rows, key=score)\n    return order[:k]\n\nclass Index:\n    def __init__(self, path):\n        self.path = path\n",
    "names": "Anna Nowak\nBen Okafor\nClara Lindqvist\nDiego Romero\nEmi Tanaka\nFarid Haddad",
    "references": "See https://example.org/guide for the details, which we have not repeated here because they are long and have changed since then.",
}


def _among_documents(spark, folder, texts):
    """What ``assessed`` says of texts put among the documents of a folder."""
    base = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**9 + i, t, "en") for i, t in enumerate(texts.values())], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in spam.assessed(base.union(extra)).collect()}
    return {name: got[10**9 + i] for i, name in enumerate(texts)}


def test_forms_of_spam_and_of_writing(spark, medium):
    pages = {f"{name} {kind}": t for kind, make in (
        ("alone", lambda t: t), ("beside prose", lambda t: PROSE * 2 + "\n" + "\n".join([t] * 6)),
    ) for name, t in ((n, make(t)) for n, t in (SPAM | OTHER_SPAM).items())}
    fine = FINE | OTHER_FINE | {f"prose with {name}": PROSE * 60 + "\n" + t for name, t in SPAM.items()}
    got = _among_documents(spark, medium, pages | fine)
    assert {n for n in pages if not got[n]["spam"]} == set()
    assert {n for n in fine if got[n]["spam"]} == set()


def test_the_distance_decides(spark, medium):
    listed = {n: t for n, t in (FINE | OTHER_FINE).items() if n in ("column header", "names", "table")}
    kept = _among_documents(spark, medium, listed)
    assert all(r["share"] > 0.5 and not r["candidate"] for r in kept.values())
    got = spam.assessed(spark.read.parquet(f"{medium}/documents.parquet")).toPandas()
    # distance and direction alone: all of the flagged, and hardly anything else
    assert 30 < got["spam"].sum() <= got["candidate"].sum() < 1.2 * got["spam"].sum()


@pytest.mark.parametrize("text", [None, "", "  \n", "​", "🧬", "<p></p>", "n/a", "TODO", "<" * 5000, "a" * 200_000, "<a href=" * 3000, "# " * 9, "1 2 3", "结构"])
def test_odd_texts(text):
    lang, words, share, features = spam.assess(text, LEXICON)
    assert share <= 1 and len(features) == len(spam.FEATURES) and all(f == f for f in features)


def test_assessed(spark, medium):
    base = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text", F.lit("en").alias("language"), F.lit(5).alias("share"))
    known = base.agg(F.max("doc_id")).first()[0]
    rows = [(2**60 + i, t) for i, t in enumerate(list(SPAM.values()) * 2)] + [(2**40 + i, t) for i, t in enumerate([None, "", " ", *FINE.values()])] + [(None, PROSE)]
    df = base.union(spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id bigint, text string, language string, share int"))
    got = spam.assessed(df).collect()
    assert len(got) == df.count()
    assert {r["doc_id"] for r in got if r["spam"] and r["doc_id"] > known} == {2**60 + i for i in range(2 * len(SPAM))}
    assert spam.assessed(df.limit(0)).count() == 0
    nothing = df.where(f"doc_id IN ({2**40}, {2**40 + 1})")
    assert [r["spam"] for r in spam.assessed(nothing).collect()] == [False, False]


def test_function_words_are_learned_from_texts_of_a_language(spark):
    rows = [(i, f"Dit is de tekst met het nummer {i} en hij is niet lang maar wel goed", "nl") for i in range(400)] + [(900 + i, "zo zo", "xx") for i in range(3)]
    learned = spam.function_words(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert "nl" in learned["het"] and "nl" in learned["en"] and set(learned["de"]) >= {"nl", "fr"} and "nummer" not in learned and "zo" not in learned
    lang, _, _, features = spam.assess("Dit is niet de tekst en het is wel goed, maar hij is lang.", learned)
    assert lang == "nl" and features[3] > 0.5


@pytest.mark.parametrize("anchor", ['<a href="http://shop.example/{i}"><b>Kinase {i}</b> <i>Deals</i></a>', '<a href="http://shop.example/{i}/' + "x" * 1200 + '">Kinase Deals</a>', '<a href="http://shop.example/{i}">' + "kinase " * 90 + "</a>"])
def test_links_of_nested_and_long_anchors_are_kept(anchor):
    from domainloom.llm.spam import assess, plain

    assess = partial(assess, lexicon=LEXICON)
    text = "\n".join(anchor.format(i=i) for i in range(8))
    assert plain(text).count("] (http://shop.example/") == 8
    assert assess(text)[3][0] > 0 and assess(text)[2] > 0.5
