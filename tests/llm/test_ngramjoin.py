"""Operator 4: links about the threshold against brute force, and which groups are opened."""

import numpy as np
import pytest

from tagloom.llm import ngramjoin
from tagloom.llm.textkit import U64
from tagloom.llm.workspace import Workspace

from test_ops import brute_components


def families(rng, n, size, share):
    """Texts of ``n`` families whose members share about ``share`` of ``size`` words with a base, at any places."""
    items = []
    for f in range(n):
        base = [f"f{f}w{k}" for k in range(size)]
        for _ in range(int(rng.integers(1, 30))):
            w = list(base)
            at = int(rng.integers(0, size))
            m = int(size * (1 - share) * rng.uniform(0.2, 1.8))
            for k in range(at, min(size, at + m)):
                w[k] = f"r{rng.integers(1e9)}"
            items.append((len(items), " ".join(w[: int(rng.integers(size * 3 // 4, size + 1))])))
    return items


@pytest.mark.parametrize("group", [4, 128])
def test_links_about_the_threshold(spark, monkeypatch, group):
    monkeypatch.setattr(ngramjoin, "GROUP", group)
    monkeypatch.setattr(ngramjoin, "QUERIES", 3 * group)
    items = families(np.random.default_rng(3), 12, 60, 0.86)
    items += [(1000 + i, t) for i, (_, t) in enumerate(items[::7])] + [(2000, " ".join(t for _, t in items[:3]))]
    space = Workspace(spark, "t")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), space=space, tidy=False).collect()]
    assert sorted(got, key=repr) == brute_components(items)
    asked, qualified = space.read("asked").count(), space.read("qualified").count()
    assert 0 < qualified < asked
    # every part's union is stored before any query
    assert space.read("parts").filter("a is null").count() == space.read("members").select("home", "part").distinct().count()


def test_templates_below_the_threshold_meet_nowhere(spark):
    rng = np.random.default_rng(4)
    shared = [f"s{k}" for k in range(100)]
    items = [(i, " ".join(shared + [f"u{i}_{k}" for k in range(24)] + [f"r{rng.integers(1e9)}"])) for i in range(300)]
    space = Workspace(spark, "t")
    got = ngramjoin.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), space=space, tidy=False).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == 300
    assert space.read("asked").count() == 0


def test_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40_000, int(rng.integers(1, 9_000)), dtype=U64)) for _ in range(9)]
    common = ngramjoin.overlaps(sets, np.unique(np.concatenate(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert common[i, j] == len(np.intersect1d(a, b)) == ngramjoin.overlap(a, b)
