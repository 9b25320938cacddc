"""Operator 2: the base against brute force, probabilities that sum to one, and gain on held-out texts."""

import math
import os
import zlib

import numpy as np
import pytest
from test_ops import DOCS, rows, split

from tagloom.llm import lmscore
from tagloom.llm.textkit import SPACE
from tagloom.llm.workspace import Workspace

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 0.5) for i, t in rows()], DOCS)


def test_base_is_that_of_brute_force(spark, docs):
    got = lmscore.score_texts(docs, modulus=3, held=1).collect()
    assert len(got) == len(rows())
    train, seen = [], {}
    for i, t in rows():
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            train += [*split(t, True), b"\n"]
    for w in train:
        seen[w] = seen.get(w, 0) + 1
    n, v = len(train), len(seen)
    want = []
    for i, t in rows():
        ws = [*split(t, True), b"\n"]
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, len(ws), sum(w in seen for w in ws), n, round(sum(math.log10((seen.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)))
    mine = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr) and all(r["score"] < 0 for r in got)


def test_odd_tables(spark, docs):
    assert lmscore.score_texts(docs.limit(0)).count() == 0
    untrained = lmscore.score_texts(docs.selectExpr("cast(null as long) as doc_id", "text")).collect()
    assert len(untrained) == len(rows()) and all(r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 and not r["held_out"] for r in untrained)
    blank = lmscore.score_texts(spark.createDataFrame([(1, None), (2, ""), (1, " ")], "doc_id long, text string")).collect()
    assert [r["n_tokens"] for r in blank] == [1, 1, 1]


def trained(spark, texts, name="t"):
    space = Workspace(spark, name)
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    tokens, sizes, n = lmscore.tokenised(frame, 1_000_000, 999_999, "doc_id", "text", space)
    tables = [np.zeros(s, np.float32) for s in sizes.shapes]
    for turn in range(lmscore.ROUNDS):
        tables = lmscore._train(tokens, turn, tables, sizes, n, 1_000_000, 999_999)
    return tokens, sizes, tables, lmscore.spelling(tokens)


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"v{int(k)}" for k in 90 * rng.random(40) ** 3)) for i in range(80)]
    tokens, sizes, tables, spelling = trained(spark, texts)
    for row in tokens.limit(1).collect():
        t = lmscore.Tokens(row.asDict())
        classes = lmscore.class_of(t.count, t.trait)
        # any of the words at one place: its history stays, its own class, slot and count are those of each word
        place = 25
        total = 0.0
        first = {}
        for i, w in enumerate(t.words.tolist()):
            first.setdefault(w, i)
        words = list(first.values())
        for i in words:
            own = lmscore.Tokens(row.asDict())
            for column in ("key", "count", "trait", "slot", "words"):
                getattr(own, column)[place] = getattr(t, column)[i]
            now = classes.copy()
            now[place] = classes[i]
            total += 10 ** lmscore.log_chances(own, now, tables, sizes, np.zeros(len(t.keys)))[place]
        one, _ = t.history(classes, sizes)
        unseen = lmscore.chance(tables[0], one[place : place + 1], sizes.of_class[None])[0, 0]
        assert len(words) == sizes.v and 0 < unseen < 1 and abs(total + unseen - 1) < 1e-4
    data = np.frombuffer(b"v12 zq4x", np.uint8)
    codes, _ = lmscore.spellings(data, np.array([0, 4]), np.array([3, 8]))
    able = np.append(np.flatnonzero(~SPACE), 256)
    for row in codes:
        every = (row // 257 * 257)[None] + able[:, None]
        assert abs((10 ** spelling.log_chance(every)).sum() - 1) < 1e-9


def test_spellings():
    data = np.frombuffer(b"xAb c", np.uint8)
    codes, word = lmscore.spellings(data, np.array([1, 4, 0]), np.array([3, 5, 0]))
    assert codes[:, 0].tolist() == [97, 98, 256, 99, 256, 256] and word.tolist() == [0, 0, 0, 1, 1, 2]
    assert [divmod(int(c) - 257, 257) for c in codes[:, 1]] == [(256, 97), (97, 98), (98, 256), (256, 99), (99, 256), (256, 256)]
    assert codes.max() < lmscore.SPELLING_ROWS * 257 and len({c // 257 for c in codes[:, 3].tolist()}) == 4
    assert lmscore.spellings(data[:0], np.array([0]), np.array([0]))[0][:, 0].tolist() == [256]


def test_history_is_learned(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"a{k} then{k}" for k in rng.integers(0, 40, 60))) for i in range(400)]
    got = {r["doc_id"]: r for r in lmscore.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    # every second word follows from the one before
    assert sum(r["score"] for r in got.values()) > 0.8 * sum(r["base_score"] for r in got.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_held_out_gain(spark):
    got = lmscore.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").toPandas()
    print("all words", got.score.sum() / got.base_score.sum())
    gain = got.known_score.sum() / got.known_base.sum()
    print("share of the base's log10 loss on known words", gain)
    assert gain < 0.94
