"""Incremental refresh: what is read again, what is kept, and that the result is that of a full run."""

import os

import pytest

from tagloom.config import Config, parse_args
from tagloom.operators.extract import extract_tags, job_of
from tagloom.plans.generate import generate
from tagloom.sources import tag_cache
from tagloom.sources.tag_cache import TagCache

FIELDS = "file_ord long, rel_path string, lang string, content binary, stat string"


@pytest.fixture
def run(spark, tmp_path):
    cache = TagCache(spark, f"file://{tmp_path}/cache", "k")

    def once(rows, cache=cache):
        """Tags by file, and the files that were extracted."""
        asked = []

        def extract(some):
            asked.extend(r["rel_path"] for r in some.select("rel_path").collect())
            return extract_tags(some, job_of(Config()))

        out = cache.extract(spark.createDataFrame([(i, p, lang, None if c is None else c.encode("latin-1"), s) for i, (p, lang, c, s) in enumerate(rows)], FIELDS), extract)
        found = sorted((r["file_ord"], r["tag_ord"], r["name"], r["file_name"], (r["error"] or "")[:9]) for r in out.collect())
        return [(name, file, error) for _, _, name, file, error in found], sorted(asked)

    once.cache = cache
    return once


def test_only_changes_are_extracted(run):
    tree = [("a.py", "python", "x = 1\ny = 2\n", "1"), ("b.py", "python", "def f(): pass\n", "2"), ("c.lua", "lua", "function g() end\n", None), ("n", None, "z", "3")]
    first = run(tree)
    assert first == ([("x", "a.py", ""), ("y", "a.py", ""), ("f", "b.py", ""), ("g", "c.lua", "")], ["a.py", "b.py", "c.lua"])
    assert run(tree) == (first[0], [])
    # touched: another time, the same content; changed; gone; new; renamed; another language
    tree = [("new.py", "python", "q = 1\n", "9"), ("a.py", "python", "x = 1\ny = 2\n", "7"), ("c.lua", "lua", "function h() end\n", None), ("d.py", "python", "def f(): pass\n", "2")]
    assert run(tree) == ([("q", "new.py", ""), ("x", "a.py", ""), ("y", "a.py", ""), ("h", "c.lua", ""), ("f", "d.py", "")], ["c.lua", "d.py", "new.py"])
    assert run(tree)[1] == []
    assert run([("c.lua", "python", "function h() end\n", None)])[1] == ["c.lua"]
    assert run([]) == ([], []) and run(tree[:1])[0] == [("q", "new.py", "")]


def test_a_file_without_tags_is_not_read_again(run):
    assert run([("e.py", "python", "", "1")]) == ([], ["e.py"])
    assert run([("e.py", "python", "", "1")]) == ([], [])


def test_errors_are_tried_again(run):
    tree = [("a.py", "python", "\xff", "1"), ("b.py", "python", "x = 1\n", "1")]
    assert run(tree) == ([(None, "a.py", "UnicodeDe"), ("x", "b.py", "")], ["a.py", "b.py"])
    assert run(tree) == ([(None, "a.py", "UnicodeDe"), ("x", "b.py", "")], ["a.py"])
    tree[0] = ("a.py", "python", "y = 1\n", "1")
    assert run(tree) == ([("y", "a.py", ""), ("x", "b.py", "")], ["a.py"])


def test_a_dead_writer_leaves_nothing(run, monkeypatch, spark):
    run([("a.py", "python", "x = 1\n", "1")])
    with monkeypatch.context() as m:
        m.setattr(TagCache, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run([("a.py", "python", "x = 2\nz = 3\n", "2")])
    assert run([("a.py", "python", "x = 1\n", "1")]) == ([("x", "a.py", "")], [])


def test_generations_are_made_one(run, monkeypatch):
    monkeypatch.setattr(tag_cache, "GENERATIONS", 2)
    tree = [(f"{i}.py", "python", f"x{i} = 1\n", "0") for i in range(4)]
    for k in range(5):
        tree[k % 4] = (f"{k % 4}.py", "python", f"y{k} = 1\n", str(k + 1))
        rows, asked = run(tree)
        assert len(rows) == 4 and asked == ([f"{k % 4}.py"] if k else [f"{i}.py" for i in range(4)])
        assert len(run.cache.generations()) <= 3
    assert run(tree)[1] == []


def test_generate_with_a_cache(spark, tmp_path, monkeypatch):
    """The tags file of a refreshed run is that of a full one, whatever happened to the tree."""
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "home"))
    src = tmp_path / "src"
    src.mkdir()
    monkeypatch.chdir(src)
    for i in range(6):
        (src / f"f{i}.py").write_text(f"a{i} = 1\n\ndef g{i}(): pass\n")
    (src / "s.lua").write_text("function l() end\n")

    def both():
        for name, more in (("cached", ["--plugin-cache", "python"]), ("full", [])):
            assert generate(spark, parse_args(["-f", f"../{name}", *more, "."]), str(src)) == 0
        assert (tmp_path / "cached").read_text() == (tmp_path / "full").read_text()

    both()
    (src / "f1.py").write_text("b = 1\n")
    (src / "f2.py").unlink()
    (src / "f9.py").write_text("c = 1\n")
    os.utime(src / "f3.py", (1, 1))
    (src / "s.lua").write_text("function m() end\n")
    both()
    both()
