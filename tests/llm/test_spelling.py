"""Operator 13 against all pairs, and its words against a plain count."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tagloom.llm import spelling
from tagloom.llm.workspace import Workspace


def brute_words(rows, drop, least_chars=6, least=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least_chars and n >= least}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    near = {w: [] for w in words}
    for a, b in combinations(sorted(words), 2):
        if abs(len(a) - len(b)) < 2 and distance_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out, key=repr)


def vocabulary(seed, n, letters, low=1, high=9):
    rng, words = np.random.default_rng(seed), {}
    while len(words) < n:
        words["".join(rng.choice(list(letters), rng.integers(low, high)))] = int(1.5 ** rng.integers(0, 25)) + 1
    return words


def found(spark, words, **more):
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    out = spelling.variants(frame, Workspace(spark, "t"), **more)
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("limit", [spelling.LIMIT, 60])
def test_variants_against_all_pairs(spark, limit):
    """Few letters make hot groups; with a small limit these are split into slices."""
    for words in (vocabulary(1, 500, "ab", 2, 12), vocabulary(2, 700, "abcé漢", 2), {**vocabulary(3, 200, "xyz", 6, 9), "x" * 3_000: 5, "x" * 2_999: 40, "x" * 1_500 + "y" + "x" * 1_499: 3}):
        assert found(spark, words, limit=limit) == brute_variants(words)


def test_chains_and_ties(spark):
    words = {"receive": 5_000, "recieve": 7, "receiv": 900, "recive": 35, "receives": 5_000, "reciave": 1, "zzzzzz": 5, "zzzzzy": 5}
    assert found(spark, words) == brute_variants(words)
    assert found(spark, {"lonely": 9}) == [("lonely", 9, 0, None, None, "lonely")]
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty, Workspace(spark, "t")).count() == 0


def test_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = list(vocabulary(7, 300, "abcdeÀéß×÷ÿ", 4, 9))
    rows = [(i, " ".join(rng.choice(base, 200)) + " UPPER Case123mixed_words naïveté" * 3) for i in range(40)]
    rows += [(None, "no identity here " * 6), (3, None), (4, ""), (4, rows[4][1]), (5, "x" * 200_000 + "-" + "\n".join(rng.choice(base, 400))), (6, "Ā" * 8 + "lettersĀletters " * 5)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string")
    for counted in (spelling.COUNTED, 50):
        monkeypatch.setattr(spelling, "COUNTED", counted)
        for drop in (0, 3, 199):
            assert {r["word"]: r["n"] for r in spelling.word_counts(frame, drop=drop).collect()} == brute_words(rows, drop)
    assert spelling.word_counts(frame.limit(0), drop=199).count() == 0


def test_one_edit():
    words = list(vocabulary(9, 60, "abc", 1, 6))
    for a in words:
        for b in words:
            if a != b and len(a) <= len(b):
                assert spelling.one_edit(a, b) == distance_one(a, b)
