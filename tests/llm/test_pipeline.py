"""The pipeline's stages against brute force on a small corpus, and op1's accuracy on the labelled table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import brute_components, tokenizer

import corpus_pipeline
from tagloom.llm import decontam, langid, queries
from tagloom.llm.workspace import Workspace

SF = "/root/testdata/sf0.1"


def corpus():
    rng = np.random.default_rng(12)
    tongue = {
        "en": "the house of people and water that is with from they were have been some time other which would there about through".split(),
        "de": "das haus der leute und wasser nicht ist mit von sie waren haben gewesen einige zeit andere welche w\u00fcrde dort durch".split(),
    }
    say = lambda lang, n: " ".join(rng.choice(tongue[lang]) + (str(rng.choice(list("abcdefgh"))) * int(rng.integers(0, 3))) for _ in range(n))
    item = " ".join(f"item{k}" for k in range(25)) + " " + say("en", 10)
    passage = say("en", 60)
    rows = [(i, say("en" if i % 3 else "de", 120), "en" if i % 3 else "de") for i in range(40)]
    rows += [(100 + i, t, lang) for i, (_, t, lang) in enumerate(rows[:6])]  # copies
    rows += [(200 + i, t.rsplit(" ", 4)[0] + " x y z w", lang) for i, (_, t, lang) in enumerate(rows[6:10])]  # near copies
    rows += [(300 + i, say("en", 40) + "\n\n" + passage + "\n" + say("en", 40), "en") for i in range(5)]
    rows += [(400, say("en", 50) + " " + item + " " + say("en", 50), "en"), (401, " ".join(w for i, w in enumerate(item.split()) if i % 6), "en")]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (None, say("en", 90), "en"), (None, rows[0][1], "de"), (3, rows[3][1], "en")]
    return rows, item


def windows(words):
    return [tuple(words[k : k + 13]) for k in range(len(words) - 12)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, item = corpus()
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, now, seen = dict(corpus_pipeline.STAGES), frame, {}
    for name in list(stages)[:4]:
        now = Workspace(spark, "t").write(stages[name](spark, now, str(tmp_path)), name)
        seen[name] = [tuple(r) for r in now.collect()]
        assert now.columns == frame.columns
    # language: the operator's own judgement, text by text
    rank = langid.scorer(langid.learn(frame))

    def accepted(t):
        if not any(c.isalpha() for c in t or ""):
            return False
        best = rank(langid.letters(t))
        return (best[1][0] - best[0][0]) / best[0][0] >= langid.MARGIN

    kept = [r for r in frame.collect() if accepted(r["text"])]
    assert sorted(seen["language_id"], key=repr) == sorted(map(tuple, kept), key=repr) and len(kept) >= len(rows) - 6
    # near duplicates: one row of each component, null ids after all others
    numbered = [((1 << 62) + k if r[0] is None else r[0], r[1]) for k, r in enumerate(seen["language_id"])]
    parts = {i: c for i, _, c in brute_components(numbered)}
    want = {r[0] for r, (i, _) in zip(seen["language_id"], numbered) if parts[i] == i}
    got = [r[0] for r in seen["ngram_jaccard_join"]]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and not {100, 105, 200, 203} & set(got)
    # repeated passages: each word of a window that begins in a smaller document goes, and nothing else
    before = sorted(seen["ngram_jaccard_join"], key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for k, r in enumerate(before):
        for w in windows(r[1].split()):
            first.setdefault(w, k)
    left = {}
    for k, r in enumerate(before):
        words = r[1].split()
        gone = {i + j for i, w in enumerate(windows(words)) if first[w] < k for j in range(13)}
        left[r[0]] = [w for i, w in enumerate(words) if i not in gone]
        assert gone or (r in seen["substring_dedup"])
    assert {r[0]: r[1].split() for r in seen["substring_dedup"]} == left and len(left[301]) < len(left[300])
    assert all(r[4] == len(r[1]) and ("\n\n" in r[1]) == (300 <= (r[0] or 0) < 305) for r in seen["substring_dedup"])
    # leaks: whoever aligns
    words = lambda t: np.array([hash(w) for w in decontam.plain(t).split()], np.int64)
    leak = lambda t: decontam.smith_waterman(words(item), words(t))[0] >= decontam.THRESHOLD * 2 * len(words(item))
    assert sorted(map(repr, seen["benchmark_decontamination"])) == sorted(repr(r) for r in seen["substring_dedup"] if not leak(r[1]))
    assert not {400, 401} & {r[0] for r in seen["benchmark_decontamination"]}
    # packing: every id of every text once, in order
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    packed = stages["best_fit_packing"](spark, now, str(tmp_path)).collect()
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for i, text, *_ in seen["benchmark_decontamination"]:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        if i is not None:
            assert b"".join(p for _, p in sorted(pieces[i])) == ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_id(spark, SF).filter("held_out and lang_pred <> 'und'").join(docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97 and got.score.between(0, 1).all()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names with dots and backticks and names that the operators use themselves change nothing and come through."""
    rows, item = corpus()
    plain = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = {"a.b": "x", "key": "k", "key_": "l", "score": "0.5", "`c`": "y", "component_id": "z", "block": "b", "rid": "r", "keep_0": "q", "c0": "c", "count": "n"}
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = plain
    for name, value in odd.items():
        wide = wide.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = (Workspace(spark, "t").write(stage(spark, frame, str(tmp_path)), name) for frame in (plain, wide))
        if name != "best_fit_packing":
            assert wide.columns == [*plain.columns, *odd]
            kept = [tuple(r) for r in wide.collect()]
            assert {r[len(plain.columns) :] for r in kept} == {tuple(odd.values())}
            assert sorted((r[: len(plain.columns)] for r in kept), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert wide.count() == plain.count()
