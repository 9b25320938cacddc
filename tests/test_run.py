"""Whole runs over small trees: discovery, resolution, tags files, append and the command line."""

import os

import pytest
from pyspark.sql import functions as F

from tagloom import cli
from tagloom.config import Config, parse_args
from tagloom.functions import text as fx
from tagloom.operators import tags
from tagloom.operators.resolve import resolve
from tagloom.plans.generate import generate
from tagloom.plans.languages import Edit, build_registry
from tagloom.sources import files, plugins, tagfile


def make(tmp_path, **texts):
    for name, text in texts.items():
        p = tmp_path / name.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def found_in(spark, *args, **more):
    """Names and errors, in order."""
    rows, errors = files.discover(spark, *args, **more)
    return [r["path"] for r in rows.orderBy("file_ord").collect()], [r["error"] for r in errors.collect()]


def test_scan_finds_hidden_names_and_excludes(spark, tmp_path):
    for n in (".bashrc", "_x.py", "sub/a.py", "sub/b.o", "skip/c.py"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("")
    os.symlink(tmp_path / "_x.py", tmp_path / "link.py")
    found, _ = found_in(spark, [str(tmp_path)], ["*.o", "skip"])
    assert [os.path.relpath(f, tmp_path) for f in found] == [".bashrc", "_x.py", "sub/a.py"]
    given, errors = found_in(spark, [str(tmp_path / "sub/b.o")] * 2 + [str(tmp_path / "gone")], ["*.o"])
    assert len(given) == 2 and len(errors) == 1
    assert found_in(spark, [str(tmp_path)], recurse=False)[1]
    assert files.relative("./a/b.py", ".") == "a/b.py" and files.relative(os.path.abspath("q/z.py"), "q") == "z.py"


@pytest.mark.parametrize("ahead", [1, 12, 10_000])
def test_discovery_equals_a_walk(spark, tmp_path, monkeypatch, ahead):
    """However far a task walks on: deep chains, wide folders, empty ones, links in circles, odd names and facts of files."""
    names = ["a/" * 9 + "deep.py", "é/ü b.py", "w/%20#?.py", "w/x.o", "it's.py", ".git/HEAD"] + [f"w/k{i}/f{i}.py" for i in range(30)]
    for i, n in enumerate(names):
        make(tmp_path, **{n.replace("__", "/"): "x" * i})
    (tmp_path / "empty/er").mkdir(parents=True)
    (tmp_path / "it's.py").chmod(0o755)
    os.symlink(tmp_path, tmp_path / "w/round")
    os.symlink(tmp_path / "w", tmp_path / "linked")
    with open(os.path.join(os.fsencode(tmp_path), b"w", b"\xff.py"), "wb"):
        pass
    rows, errors = files.discover(spark, [str(tmp_path)], ["*.o"], base=str(tmp_path), ahead=ahead)
    got = rows.orderBy("file_ord").collect()
    assert [r["rel_path"] for r in got] == sorted((n for n in names if not n.endswith(".o")), key=str.encode)
    for r in got:
        st = os.stat(r["path"])
        assert (r["size"], r["is_exec"], r["stat"]) == (st.st_size, bool(st.st_mode & 0o111), f"{st.st_size}:{st.st_mtime_ns}:{st.st_ino}")
    assert [r["error"].endswith("not UTF-8") for r in errors.collect()] == [True]
    # a link that is named is followed, a URI is a path, names stay as they were written
    monkeypatch.chdir(tmp_path)
    linked = files.discover(spark, ["linked", "./é", f"file://{tmp_path}/it's.py", "a"], ahead=ahead, base="/nowhere")[0].orderBy("file_ord").collect()
    shown = [r["rel_path"] for r in linked]
    assert shown[0] == "linked/%20#?.py" and shown[-3:] == ["é/ü b.py", f"{tmp_path}/it's.py", "a/" * 9 + "deep.py"] and len(shown) == 35
    assert found_in(spark, [str(tmp_path / "empty")], ahead=ahead) == ([], [])


def test_files_are_dealt_by_size(spark):
    rows = spark.createDataFrame([(f"f{i}", i, 1 << (i % 20)) for i in range(100)], "path string, file_ord long, size long")
    dealt = files.balanced(rows, 5).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.max("size").alias("most")).collect()
    assert len(dealt) == 5 and sum(r["n"] for r in dealt) == 100 and all(r["most"] == 1 << 19 for r in dealt)
    large = spark.createDataFrame([(f"f{i}", i, files.TASK_BYTES) for i in range(7)], "path string, file_ord long, size long")
    assert files.balanced(large, 2).rdd.getNumPartitions() == 7 and files.balanced(rows.limit(0), 3).count() == 0


def test_file_systems_of_other_schemes(tmp_path):
    from pyarrow import fs

    from tagloom.sources import storage

    make(tmp_path, **{"d__x.py": "abc", "y": ""})
    assert sorted((e.name, e.is_folder, e.is_file, e.size) for e in storage.entries_in(fs.LocalFileSystem(), str(tmp_path)) if not e.is_folder) == [("y", False, True, 0)]
    assert [e.size for e in storage.entries_in(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "d")] == [3]
    assert storage.is_remote("hdfs://n:8020/a b") and not storage.is_remote("file:///a") and not storage.is_remote("c:x") and not storage.is_remote("/a:/b")
    assert storage.local("file:///a%20b") == "/a%20b" and storage.local("file:/a") == "/a" and storage.local("a/b") == "a/b"
    assert files.relative("s3://b/t/x.py", "s3://b/t") == "x.py" and files.relative("s3://b/u/x.py", "s3://b/t") == "s3://b/u/x.py"
    storage.put(f"file://{tmp_path}/n/m/z", b"12")
    with storage.opened(f"file://{tmp_path}/n/m/z") as f:
        assert f.read() == b"12"


@pytest.mark.parametrize("pattern, name, want", [("*.py", "a.py", True), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[]]", "]", True), ("[a", "[a", True), ("[a-c]*", "dx", False), ("a.b", "axb", False)])
def test_globs(spark, pattern, name, want):
    assert spark.range(1).select(F.lit(name).rlike(fx.glob_regex(pattern))).first()[0] is want


def test_globs_count_in_bytes(spark):
    """Against a plain matcher of bytes that tries every split at a star."""

    def one(p, c):
        """(whether the token that p begins with takes c, what follows it)."""
        if p[:1] == b"[":
            k = 1 + (p[1:2] in (b"!", b"^"))
            end = p.find(b"]", k + 1)
            if end > 0:
                body, hit, i = p[k:end], False, 0
                while i < len(body):
                    if i + 2 < len(body) and body[i + 1] == 45:
                        hit |= body[i] <= c <= body[i + 2]
                        i += 3
                    else:
                        hit |= body[i] == c
                        i += 1
                return hit != (k == 2), p[end + 1 :]
        return p[:1] == b"?" or p[0] == c, p[1:]

    def plain(p, n):
        if not p:
            return not n
        if p[:1] == b"*":
            return any(plain(p[1:], n[i:]) for i in range(len(n) + 1))
        if not n:
            return False
        hit, rest = one(p, n[0])
        return hit and plain(rest, n[1:])

    patterns = ["*", "?", "??", "é", "?é", "[é]", "[é]?", "*[!a-z]", "[z-a]x", "[!z-a]x", "[]x]", "[!]]", "[^]a]*", "[a-]", "[-a]", "a[", "[", "[]", "[!", "a\\b", "a.b", "*.gem?pec", "a*b*c", "[&&x]", "\n", "", "x$", "(a|b)", "日*", "?本", "[^\x00]"]
    names = ["", "a", "é", "aé", "ab", "x", "]", "-", "a[", "[", "[]", "[!", "a\\b", "a.b", "axb", "foo.gemspec", "aXbYc", "abc\n", "\n", "a\n", "&", "x$", "(a|b)", "日本", "本", "zx", "!x", "x\n"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select("n", *(fx.glob_match(F.col("n"), p).alias(str(i)) for i, p in enumerate(patterns))).collect()
    for r in got:
        for i, p in enumerate(patterns):
            assert r[str(i)] is plain(p.encode(), r["n"].encode()), (p, r["n"])


RESOLVED = [
    ("a.rs", b"", False, "rust"),
    ("a.h", b"int x;", False, "c"),
    ("a.h", b"namespace x {}", False, "c++"),
    ("Rakefile", b"", False, "ruby"),
    ("run", b"#!/usr/bin/env -S X=1 python3.11\n", True, "python"),
    ("run", b"#!/bin/dash -e\n", True, "shell"),
    ("run", b"#!/bin/sh\n", False, None),
    ("x.unknown", b"", False, None),
    (".bashrc", b"", False, "shell"),
]


def test_resolution(spark):
    rows = spark.createDataFrame([(i, p, c, x) for i, (p, c, x, _) in enumerate(RESOLVED)], "file_ord long, rel_path string, content binary, is_exec boolean")
    got = [r["lang"] for r in resolve(rows, build_registry()).orderBy("file_ord").collect()]
    assert got == [w for *_, w in RESOLVED]
    guess = {r["file_ord"]: r["lang"] for r in resolve(rows, build_registry(), guess=True).collect()}
    assert guess[6] == "shell" and guess[7] is None
    edited = build_registry(edits=[Edit("go", "add", "pattern", "x.*")])
    assert resolve(rows, edited).filter("file_ord = 7").first()["lang"] == "go"
    empty = rows.limit(0)
    assert resolve(empty, build_registry(), guess=True).count() == 0


def test_append_and_replace(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    make(tmp_path, **{"source.py": "def fresh():\n    pass\n", "bad.py": b"\xff\xfe"})
    old = 'existing\texisting.py\t/^def existing():$/;"\tf'
    (tmp_path / "tags").write_text(old + "\n")
    assert generate(spark, parse_args(["--append=yes", "-f", "tags", "source.py", "bad.py"]), str(tmp_path)) == 0
    body = (tmp_path / "tags").read_text().split("\n")
    assert body[0] == tags.header(True) and body[1].startswith('existing\texisting.py\t/^def existing():$/;"\t\tf') and body[2].startswith("fresh\tsource.py")
    assert generate(spark, parse_args(["-f", "tags", "source.py"]), str(tmp_path)) == 0
    assert "existing" not in (tmp_path / "tags").read_text()
    (tmp_path / "tags").write_text("not a tags file\n")
    assert generate(spark, parse_args(["--append", "-f", "tags", "source.py"]), str(tmp_path)) == 1
    assert generate(spark, parse_args(["-f", "t2", "gone.py"]), str(tmp_path)) == 1
    with pytest.raises(ValueError):
        tagfile.output_path("-x")


def test_sort_no_keeps_file_order(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    make(tmp_path, **{"b.py": "z = 1\na = 2\n", "a.py": "m = 1\n"})
    assert cli.main(["--sort=no", "-f", "-", "b.py", "a.py"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[0] == tags.header(False) and [x.split("\t")[0] for x in out[1:4]] == ["z", "a", "m"]


def test_listings(spark, capsys, tmp_path):
    assert cli.main(["--list-kinds", "rust"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[0] == "#LETTER  NAME                     ENABLED" and out[1].split() == ["n", "module", "yes"]
    assert cli.main(["--list-kinds", "nope"]) == 1
    capsys.readouterr()
    assert cli.main(["--list-maps", "GO"]) == 0
    assert capsys.readouterr().out == "go           .go\n"
    assert cli.main(["--list-languages"]) == 0
    assert "typescript" in capsys.readouterr().out
    make(tmp_path, **{"x.go": "", "y": ""})
    assert cli.main(["--print-language", str(tmp_path / "x.go"), str(tmp_path / "y")]) == 0
    assert [x.rsplit(": ", 1)[1] for x in capsys.readouterr().out.strip().split("\n")] == ["go", "NONE"]


def test_plugins_and_user_grammars(spark, tmp_path):
    good = 'name = "kt"\nversion = "1.0.0"\nabi_version = 3\nlanguage = "kotlin"\nextensions = ["kt", "kts"]\n'
    make(tmp_path, **{"p__plugin.toml": good, "p__plugin.wasm": "x", "q__plugin.toml": good.replace("3", "2"), "r__plugin.toml": "name =", "u.toml": '[[user_grammars]]\nlanguage_name = "gleam"\n'})
    assert [m["name"] for m in plugins.scan_manifests([str(tmp_path)])] == ["kt"]
    r = build_registry(plugins.all_languages([str(tmp_path)], str(tmp_path / "u.toml")))
    assert r.ext["kt"] == ["kotlin"] and r.ext["gleam"] == ["gleam"]
    assert plugins.plugin_groups(plugins.manifests_table(spark, [str(tmp_path)])).first()["extensions"] == ["kt", "kts"]
    (tmp_path / "i.json").write_text('{"abi_version": 3, "plugins": [{"name": "kt", "version": "1.2.0", "extensions": ["kt"], "wasm_size": 3}]}')
    index = plugins.read_index(spark, str(tmp_path / "i.json"))
    assert plugins.updates(index, plugins.manifests_table(spark, [str(tmp_path)])).count() == 1
    import hashlib

    assert plugins.install(str(tmp_path / "p/plugin.wasm"), hashlib.sha256(b"x").hexdigest(), str(tmp_path / "new")).endswith("plugin.wasm")
    with pytest.raises(ValueError):
        plugins.install(str(tmp_path / "p/plugin.wasm"), "0", str(tmp_path / "new"))
    assert plugins.uninstall(str(tmp_path / "p")) and not plugins.uninstall(str(tmp_path / "p"))


def test_table_function(spark):
    from tagloom.operators.extract import job_of, register_table_function

    register_table_function(spark, job_of(Config()))
    text = b"class A:\n    def f(self): pass\n"
    rows = [("x.py", "python", text), ("y", None, text), (None, "python", text), ("z.py", "python", b"\xff"), ("n.py", "python", None), ("e.py", "python", b"")]
    spark.createDataFrame(rows, "rel_path string, lang string, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("select * from tags_of_files(table(some_files) partition by (rel_path), 'class, line,nothing')")
    assert got.columns == ["file_name", "name", "address", "kind", "class", "line", "nothing"]
    assert sorted(tuple(r) for r in got.collect()) == [("x.py", "A", "/^class A:$/;\"", "c", None, "1", None), ("x.py", "f", "/^    def f(self): pass$/;\"", "m", "A", "2", None)]
    assert spark.sql("select * from tags_of_files(table(some_files), '')").columns == ["file_name", "name", "address", "kind"]
    for bad in ("table(select 1 as x), ''", "table(some_files), 7"):
        with pytest.raises(Exception, match="needed|constant text"):
            spark.sql(f"select * from tags_of_files({bad})").collect()


def test_udtf(spark):
    from tagloom.operators.extract import job_of, register_udtf

    register_udtf(spark, job_of(Config()))
    got = spark.sql("select t.name, t.kind from (select 'x.py' p, 'python' l, cast('class A: pass' as binary) c) f, lateral code_tags(f.p, f.l, f.c) t").collect()
    assert [tuple(r) for r in got] == [("A", "c")]


def test_tags_files_with_odd_lines(spark):
    lines = spark.createDataFrame([('!_TAG_X\t1\t/',), ("a\tf",), ('a\tf\t/^x$/;"\tkind:v\tline:1\t\tm',), ('b\tf\t/^y$/;"\tm\tz',), ("",)], "value string")
    got = {r["name"]: r for r in tags.parse_lines(lines).collect()}
    assert set(got) == {"a", "b"} and got["a"]["kind"] == "v" and got["b"]["kind"] == "m" and got["a"]["fields"][0]["key"] == "line"
    assert not tags.valid_tags_file(spark.createDataFrame([(" ",), ("x y",)], "value string").coalesce(1)).first()["valid"]
    assert tags.valid_tags_file(lines.limit(0)).first()["valid"]


def test_files_are_read_late_and_in_bounds(spark, tmp_path):
    from tagloom.operators.resolve import resolved_paths
    from tagloom.sources.files import ENDS, HEAD, files_table, read_ends

    big = b"#!/usr/bin/env python3\n" + b"x = 1\n" * 40_000 + b"# vim: ft=ruby\n"
    make(tmp_path, **{"a.py": big, "tool": big, "small": b"#!/bin/sh\n", "h.h": "class A {\n};\n", "none": "text"})
    (tmp_path / "tool").chmod(0o755)
    names = ["a.py", "tool", "small", "h.h", "none", "gone"]
    (tmp_path / "gone").touch()
    files = files_table(spark, [str(tmp_path / n) for n in names])
    (tmp_path / "gone").unlink()
    short = lambda rows: {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    ends = short(read_ends(files.withColumn("ask", files["path"].rlike("(tool|none|gone)$")), "ask"))
    assert ends["a.py"]["content"] is None and ends["gone"]["content"] is None
    tool = bytes(ends["tool"]["content"])
    assert len(tool) == HEAD + ENDS and tool[:HEAD] == big[:HEAD] and tool[HEAD:] == big[-ENDS:] and bytes(ends["none"]["content"]) == b"text"
    langs = {n: r["lang"] for n, r in short(resolved_paths(files, build_registry())).items()}
    assert langs == {"a.py": "python", "tool": "python", "small": None, "h.h": "c++", "none": None, "gone": None}
    guessed = {n: r["lang"] for n, r in short(resolved_paths(files, build_registry(), guess=True)).items()}
    assert guessed["small"] == "shell" and guessed["tool"] == "python"


def test_ranks(spark):
    rows = [(n, f"f{i}", "a", k, None) for i, n in enumerate("bcaab" * 9) for k in ("v", None)]
    frame = spark.createDataFrame(rows, "name string, file_name string, address string, kind string, fields array<struct<key:string,value:string>>")
    got = tags.ranked(frame).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or ""))
    assert [r["rank"] for r in got] == list(range(1, 91)) and [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    assert tags.ranked(frame.limit(0)).count() == 0


def test_versions(spark):
    from pyspark.sql import functions as F

    from tagloom.functions.text import version_status

    # the usual example of such an order
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.10", "1.2.0"]
    pairs = spark.createDataFrame([(a, b, i, j) for i, a in enumerate(order) for j, b in enumerate(order)], "a string, b string, i int, j int")
    for r in pairs.select("i", "j", version_status(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == ("update available" if r["i"] < r["j"] else "installed")


def test_marks_are_looked_for_in_first_bytes(spark):
    """8192 bytes, not characters; what the tail of a large file holds does not count."""
    class_a = "\nclass A {\npublic:\n};\n"
    cases = [("é" * 4_096 + class_a, "c"), ("é" * 4_000 + class_a, "c++"), ("x" * 8_192 + class_a, "c"), ("x" * 60_000 + class_a, "c"), (class_a, "c++"), ("x" * 8_191 + "é" + class_a, "c")]
    files = spark.createDataFrame([(i, f"h{i}.h", t.encode()) for i, (t, _) in enumerate(cases)], "file_ord long, rel_path string, content binary")
    assert [r["lang"] for r in resolve(files, build_registry()).orderBy("file_ord").collect()] == [lang for _, lang in cases]


def test_manifests_one_level_down(tmp_path):
    text = 'name = "{0}"\nversion = "1.0.0"\nabi_version = 3\nlanguage = "l{0}"\nextensions = ["{0}"]\nwasm_file = "m.py"\n'
    for name, place in (("a", "a"), ("b", "b"), ("deep", "b/c")):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "plugin.toml").write_text(text.format(name))
        (tmp_path / place / "m.py").write_text("")
    names = lambda *folders: [m["name"] for m in plugins.scan_manifests(list(folders))]
    assert names(str(tmp_path)) == ["a", "b"] and names(str(tmp_path / "b")) == ["b"] and names(str(tmp_path / "none")) == []
    assert names(f"{tmp_path}/**") == ["a", "b", "deep"] and names(f"{tmp_path}/**", str(tmp_path / "a")) == ["a", "b", "deep", "a"]


def test_a_folder_of_parts(spark, tmp_path, monkeypatch):
    """The parts, one behind the other, are the tags file; a second run replaces or appends, and leaves nothing else."""
    (tmp_path / "src").mkdir()
    monkeypatch.chdir(tmp_path / "src")
    for i in range(12):
        (tmp_path / f"src/f{i}.py").write_text("".join(f"name_{(i * 7 + k * 5) % 97} = 1\n" for k in range(30)))
    lines = lambda: [line for part in sorted((tmp_path / "parts").glob("part-*")) for line in part.read_text().splitlines()]
    run = lambda *more: generate(spark, parse_args([*more, "."]), str(tmp_path / "src"))
    for more in ([], ["--sort", "no"], []):
        assert run("-f", "../one", *more) == 0 and run("-f", "../parts/", *more) == 0
        assert lines() == (tmp_path / "one").read_text().splitlines() and len(lines()) == 361
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts, small as they are
    try:
        assert run("-f", "../parts/") == 0 and lines() == (tmp_path / "one").read_text().splitlines()
        assert len(list((tmp_path / "parts").glob("part-*"))) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert run("--append", "-f", "../parts/") == 0 and len(lines()) == 721 and run("--append", "-f", "../one") == 0
    assert lines() == (tmp_path / "one").read_text().splitlines()
    assert sorted(os.listdir(tmp_path)) == ["one", "parts", "src"]
    empty = tagfile.read_tags(spark, str(tmp_path / "one")).limit(0)
    tagfile.write_tags_distributed(empty, str(tmp_path / "none"))
    assert [line for part in (tmp_path / "none").glob("part-*") for line in part.read_text().splitlines()] == ["!_TAG_FILE_SORTED\t1\t/0=unsorted, 1=sorted/"]
