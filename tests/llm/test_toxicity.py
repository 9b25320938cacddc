"""Operator 5: features, odd rows, the sample's join, and held-out accuracy on the labelled table."""

import os
import re

import numpy as np
import pytest

from tagloom.llm import queries, toxicity
from tagloom.llm.textkit import zip_bytes

SF = "/root/testdata/sf0.1"


def made(rng, bad):
    word = lambda: f"{rng.choice(list('abcdefgh'))}{rng.choice(['an', 'el', 'or'])}{rng.choice(['ta', 'mi'])}"
    words = [word() for _ in range(int(rng.integers(20, 120)))]
    if bad:
        words.insert(len(words) // 2, "zzfoul" + str(rng.choice(["est", "ly"])))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    return toxicity.fit([(zip_bytes(made(rng, y).encode()), y) for y in [0] * 120 + [1] * 60])


def test_scores(spark, model):
    rng = np.random.default_rng(6)
    asked = spark.createDataFrame([(i, made(rng, i % 2)) for i in range(40)], "doc_id long, text string")
    got = toxicity.score(asked, model, ["doc_id"]).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 2 == 1) for r in got)
    long = " ".join(made(rng, 0) for _ in range(20_000))
    assert toxicity.Scorer(model).scores([long])[0] < 0.5 < toxicity.Scorer(model).scores([long + " zzfoulest " + long])[0]


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, " \t"), (1, None), (3, "\u00c9 \ufb01 " * 50), (4, "x" * 1_500_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _body", "'a' as label")
    got = toxicity.score(frame, model, ["doc_id", "_body", "label"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got[:4]}) == 1
    assert toxicity.score(frame.limit(0), model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(frame.withColumn("score", frame["doc_id"]), model, ["score"])
    one = lambda m: toxicity.Scorer(m).scores(["x"])[0]
    assert 0 < one(toxicity.fit([])) < 0.5 < one(toxicity.fit([(zip_bytes(b"x"), 1)]))


def brute(text):
    plain, found = " " + re.sub(r"[\W_]+", " ", text.lower()).strip() + " ", {}
    for n in toxicity.SIZES:
        for i in range(len(plain) - n + 1):
            if " " not in plain[i + 1 : i + n - 1]:
                found[plain[i : i + n]] = found.get(plain[i : i + n], 0) + 1
    return sorted(found.values())


def test_features_are_code_points_and_pieces_do_not_matter(monkeypatch):
    texts = ["", "naïve Straße \u0436\u0438\u0437\u043d\u044c", "a b cc", "one two three " * 30, "\ud83d\ude00x\ud83d\ude00"]
    whole = [toxicity.keys_of(t) for t in texts]
    for t, (keys, often) in zip(texts, whole):
        assert sorted(often.tolist()) == brute(t)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    for t, (keys, often) in zip(texts, whole):
        k, o = toxicity.keys_of(t)
        assert (k == keys).all() and (o == often).all()
    table = toxicity.Chosen(np.unique(np.concatenate([k for k, _ in whole])))
    rows, place, level = table.features(texts)
    for i, (keys, often) in enumerate(whole):
        assert (table.table[place[rows == i]] == keys).all()
        assert (level[rows == i] == np.searchsorted(toxicity.LEVELS, often, "right") - 1).all()


def test_sample(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (3, None), (None, "n"), (4, "d"), (5, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 0), (None, 1), (4, 7), (4, None), (5, 0), (9, 1)], "doc_id long, toxic int")
    got = sorted((toxicity.unzip_bytes(b).decode(), y) for b, y in toxicity.sample(docs, labels))
    assert got == [("", 0), ("a", 0), ("b", 1), ("b2", 1)]
    assert len(toxicity.sample(docs, labels, size=(1, 1))) == 2 and toxicity.sample(docs.limit(0), labels) == [] == toxicity.sample(docs, labels.limit(0))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_held_out_accuracy(spark):
    got = queries.op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted").toPandas()
    caught = got[got.toxic == 1].predicted.mean()
    assert caught >= 0.85 and got[got.toxic == 0].predicted.mean() <= 0.005
