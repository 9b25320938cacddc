"""Operator 12: targets against the plain procedure, and what every mix must hold."""

from collections import Counter

import numpy as np
import pytest

from tagloom.llm import mixing
from tagloom.llm.workspace import Workspace

WEIGHTS = [1, 2, 3]


def words(text):
    return (text or "").encode().split()


def targets(sizes, weights, most=3.0):
    """Shares by weight; what is above the cap stops there, and the excess is shared anew by weight."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        out = [most * s for s in sizes]
        for i in free:
            out[i] = left * weights[i] / sum(weights[j] for j in free)
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            return out
        capped |= above


def corpus(rng, sources, docs):
    rows = []
    for k in range(docs):
        s = sources[0] if k % 3 == 0 else sources[rng.integers(len(sources))]
        rows.append((int(rng.integers(docs)), s, " ".join(f"{s}.{k}.{i}" for i in range(int(rng.integers(0, 400))))))
    return [*rows, (None, sources[-1], "no id"), (5, sources[1], None), (5, sources[1], ""), (7, None, "\x1c one word " * 50), (7, None, "\x1c one word " * 50)]


def made(spark, rows, key=("row",), **more):
    frame = spark.createDataFrame([(i, s, t, k, 1.0, "x") for k, (i, s, t) in enumerate(rows)], "doc_id long, source string, text string, row long, target double, `a.b` string")
    return frame, mixing.mix(frame, mixing.cycled(WEIGHTS), list(key), Workspace(spark, "t"), **more)


@pytest.mark.parametrize("shard_slots", [mixing.SHARD_SLOTS, 20])
def test_a_mix(spark, shard_slots, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 8)
    rng = np.random.default_rng(2)
    rows = corpus(rng, ["b", "a", "é", "\U0001f600", "￿", "tiny"], 240)
    frame, mix = made(spark, rows, shard_slots=shard_slots)
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(len(words(t)) for _, s, t in rows if s == name) for name in names]
    want = dict(zip(names, targets(sizes, [WEIGHTS[i % 3] for i in range(len(names))])))
    documents = {r["k0"]: r for r in mix.documents.collect()}
    assert len(documents) == len(rows)
    for k, (i, s, t) in enumerate(rows):
        d = documents[k]
        assert (d["id"], d["size"], d["source_size"]) == (i, len(words(t)), sizes[names.index(s)])
        assert d["target"] == pytest.approx(want[s], rel=1e-9)
    spans, sources = mix.spans.collect(), {r["sid"]: r for r in mix.sources.collect()}
    took, by_slot = Counter(), {}
    for r in spans:
        took[r["k0"]] += r["length"]
        by_slot.setdefault((r["sid"], r["slot"]), []).append(r)
    for sid, s in sources.items():
        taken = sum(took[k] for k, row in enumerate(rows) if row[1] == s["source"])
        assert abs(taken - s["target"]) <= 1.5 * s["length"]
        blocks = [p[0]["block"] for (i, _), p in sorted(by_slot.items()) if i == sid]
        assert len(blocks) == s["slots"]
        for k in range(0, len(blocks), s["blocks"]):  # no block twice in a pass
            assert len(set(blocks[k : k + s["blocks"]])) == len(blocks[k : k + s["blocks"]])
    assert all(took[k] <= 3 * len(words(t)) for k, (_, _, t) in enumerate(rows))
    shards = Counter(r["shard"] for r in spans)
    assert len(shards) > (8 if shard_slots == 20 else 0)
    texts = {(r["sid"], r["slot"]): (r["shard"], r["text"]) for r in mixing.shard_texts(mix.spans, frame, ["row"]).collect()}
    assert texts.keys() == by_slot.keys()
    for at, parts in by_slot.items():
        parts.sort(key=lambda r: r["place"])
        whole = [w for p in parts for w in words(rows[p["k0"]][2])[p["start"] : p["start"] + p["length"]]]
        assert texts[at] == (parts[0]["shard"], b" ".join(whole).decode())
        assert parts[0]["place"] == 0 and len(whole) <= sources[at[0]]["length"]


def test_reruns_agree_at_any_partitions(spark):
    rows = corpus(np.random.default_rng(4), ["a", "b", "c"], 90)
    first = sorted(made(spark, rows)[1].spans.collect(), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(made(spark, rows)[1].spans.collect(), key=repr) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_words_and_no_rows(spark):
    _, mix = made(spark, [(1, "a", ""), (2, None, None)])
    assert sorted((r["size"], r["target"]) for r in mix.documents.collect()) == [(0, 0.0), (0, 0.0)] and mix.spans.count() == 0
    empty = spark.createDataFrame([], "doc_id long, source string, text string, row long")
    mix = mixing.mix(empty, mixing.cycled(WEIGHTS), ["row"], Workspace(spark, "t"))
    assert mix.documents.count() == 0 and mix.spans.count() == 0


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        for key in (0, 1, 2**63):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))
