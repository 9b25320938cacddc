"""Plugin commands, modules and user grammars' query files."""

import hashlib
import json
import os
import time

import pytest

from tagloom import cli
from tagloom.config import Config, parse_args
from tagloom.operators.extract import extract_tags, job_of
from tagloom.plans.generate import generate
from tagloom.sources import plugin_store, plugins

MANIFEST = 'name = "{0}"\nversion = "{1}"\nabi_version = 3\nlanguage = "lang{0}"\nextensions = ["{0}", "{0}x"]\nwasm_file = "plugin.py"\n'
MODULE = "def extract(source, options):\n    return [Tag(line.split()[1], i, 'd') for i, line in enumerate(source.lines) if line.startswith('define ')]\n"


@pytest.fixture
def index(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    (tmp_path / "site/3").mkdir(parents=True)

    def publish(**versions):
        entries = []
        for name, version in versions.items():
            (tmp_path / f"site/{name}.py").write_text(MODULE)
            (tmp_path / f"site/{name}.toml").write_text(MANIFEST.format(name, version))
            entries.append({"name": name, "version": version, "language": f"lang{name}", "extensions": [name], "wasm_url": str(tmp_path / f"site/{name}.py"), "manifest_url": str(tmp_path / f"site/{name}.toml"), "wasm_sha256": hashlib.sha256(MODULE.encode()).hexdigest()})
        (tmp_path / "site/3/index.json").write_text(json.dumps({"abi_version": 3, "plugins": entries}))

    publish(q="1.0.0", longer="2.0.0-rc.9")
    return publish


def test_commands(spark, tmp_path, index, capsys):
    site, here = str(tmp_path / "site"), str(tmp_path / "plugins")
    run = lambda *a: (cli.main(["plugin", *a, "--plugins-dir", here, "--plugin-index-url", site]), capsys.readouterr().out.rstrip().split("\n"))
    assert run("available") == (0, ["NAME      VERSION       LANGUAGE      EXTENSIONS    STATUS", "longer    2.0.0-rc.9    langlonger    longer", "q         1.0.0         langq         q"])
    assert run("installed")[1] == [f"Plugin directory: {here}", "No plugins detected."]
    assert run("update")[1] == [f"No plugins installed under {here}."]
    assert run("install", "none")[0] == 1 and run("update", "q")[0] == 0
    assert run("install", "q") == (0, [f"Installed `q` 1.0.0 to {here}/q"]) and sorted(os.listdir(f"{here}/q")) == ["plugin.py", "plugin.toml"]
    assert "up to date" in run("install", "q")[1][0] and run("install", "q", "--force")[1][0].startswith("Installed")
    assert run("installed")[1][1:] == ["LANGUAGE    EXTENSIONS", "langq       q, qx"]
    run("install", "longer")
    index(q="1.1.0", longer="2.0.0-rc.10")
    assert run("update")[1] == ["All plugins up to date."]  # the cached index is young
    assert sorted(run("update", "--refresh")[1]) == ["Updated `longer` 2.0.0-rc.9 -> 2.0.0-rc.10", "Updated `q` 1.0.0 -> 1.1.0"]
    assert run("available")[1][1].endswith("installed") and run("update", "gone")[0] == 1
    assert run("uninstall", "q")[1] == [f"Uninstalled `q` from {here}/q"] and run("uninstall", "q")[1] == [f"`q` is not installed under {here}"]


def test_cache(tmp_path, index, monkeypatch, capsys):
    site = str(tmp_path / "site")
    path = plugin_store.cached_index(site)
    (tmp_path / "site/3/index.json").unlink()
    assert plugin_store.cached_index(site) == path and not capsys.readouterr().err
    os.utime(path, (time.time() - 2 * plugin_store.TTL,) * 2)
    assert plugin_store.cached_index(site) == path and "cannot be fetched" in capsys.readouterr().err
    with pytest.raises(OSError):
        plugin_store.cached_index(str(tmp_path / "elsewhere"))
    monkeypatch.setenv(plugin_store.BASE_VARIABLE, "from-environment")
    assert [plugin_store.base_of("flag"), plugin_store.base_of(""), plugin_store.index_location("b//"), plugin_store.index_location("x/i.json")] == ["flag", "from-environment", "b/3/index.json", "x/i.json"]
    monkeypatch.delenv(plugin_store.BASE_VARIABLE)
    assert plugin_store.base_of("", "last") == "last"


def test_a_module_of_a_plugin_extracts(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/plugin.toml").write_text(MANIFEST.format("q", "1.0.0"))
    (tmp_path / "p/plugin.py").write_text(MODULE)
    (tmp_path / "a.q").write_text("define one\nother\ndefine two\n")
    monkeypatch.chdir(tmp_path)
    assert generate(spark, parse_args(["-f", "tags", "--plugin-dir", "p", "a.q"]), str(tmp_path)) == 0
    assert [line.split("\t")[0] for line in (tmp_path / "tags").read_text().split("\n")[1:3]] == ["one", "two"]


def test_query_files_of_user_grammars(spark, tmp_path, capsys):
    (tmp_path / "g.toml").write_text('[[user_grammars]]\nlanguage_name = "kotlin"\nextensions = ["kt"]\nquery_file_path = "q.scm"\n')
    (tmp_path / "q.scm").write_text("; functions\n(function_declaration (simple_identifier) @name) @definition.function\n(unheard_of (x) @name) @definition.y\n(object_declaration (type_identifier) @name) @definition.object\n(call (x) @name) @reference.call\n")
    job = job_of(Config(user_grammars=str(tmp_path / "g.toml")))
    assert list(job.queries) == ["kotlin"] and "unheard_of" in capsys.readouterr().err
    text = b'fun <T> first(a: T) = a // fun no()\nobject Only {\n  fun String.more(): Int { val n = 1 }\n}\nval s = "fun nor()"\n'
    files = spark.createDataFrame([(0, "a.kt", "kotlin", text), (1, "b.kt", "kotlin", b"fun \xff"), (2, "c.py", "python", b"def f(): pass\n"), (3, "d", None, b"")], "file_ord long, rel_path string, lang string, content binary")
    rows = sorted((r["file_ord"], r["tag_ord"], r["name"], r["kind"], r["address"], r["error"]) for r in extract_tags(files, job).collect())
    assert [r[2:5] for r in rows if r[0] == 0] == [("first", None, '/^fun <T> first(a: T) = a \\/\\/ fun no()$/;"\t'), ("Only", None, '/^object Only {$/;"\t'), ("more", None, '/^  fun String.more(): Int { val n = 1 }$/;"\t')]
    assert [r[2] for r in rows if r[0] == 2] == ["f"] and [(r[0], r[5].split(":")[0]) for r in rows if r[5]] == [(1, "UnicodeDecodeError")]
    assert plugins.user_queries("") == {} and plugins.user_queries(str(tmp_path / "none.toml")) == {}
    (tmp_path / "q.scm").write_text("(function_declaration (simple_identifier) @name")
    assert plugins.user_queries(str(tmp_path / "g.toml")) == {} and "ends inside" in capsys.readouterr().err


def test_a_run_with_user_queries(spark, tmp_path, monkeypatch):
    (tmp_path / "g.toml").write_text('[[user_grammars]]\nlanguage_name = "kotlin"\nextensions = ["kt"]\nquery_file_path = "q.scm"\n')
    (tmp_path / "q.scm").write_text('((function_declaration name: (_) @name) @definition.function (#not-match? @name "^_"))')
    (tmp_path / "a.kt").write_text("fun b() {}\nclass A {\n  fun a() = 1\n  fun _c() = 2\n}\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    monkeypatch.chdir(tmp_path)
    assert generate(spark, parse_args(["-f", "tags", "--user-languages-config", "g.toml", "a.kt", "b.py"]), str(tmp_path)) == 0
    assert [line.split("\t")[0] for line in (tmp_path / "tags").read_text().split("\n")[1:4]] == ["a", "b", "x"]


def test_completions(capsys):
    for shell in ("bash", "zsh", "fish"):
        assert cli.main(["completions", shell]) == 0
        assert "list-kinds" in capsys.readouterr().out
    assert cli.main(["completions", "csh"]) == 1


def test_only_a_plugins_own_folder_is_replaced(tmp_path, index):
    """Names that leave the folder, manifests of another name or ABI and folders of something else are refused, and nothing is touched."""
    here, victim = tmp_path / "plugins", tmp_path / "victim"
    victim.mkdir()
    (victim / "kept").write_text("x")
    entry = {"name": "q", "version": "1.0.0", "wasm_url": str(tmp_path / "site/q.py"), "manifest_url": str(tmp_path / "site/q.toml"), "wasm_sha256": hashlib.sha256(MODULE.encode()).hexdigest()}
    for name in ("../victim", str(victim), "..", ".", "", ".q", "a/b", "a\\b", "q\0"):
        with pytest.raises(ValueError, match="plain name"):
            plugin_store.place({**entry, "name": name}, str(here))
    for manifest, why in ((MANIFEST.format("other", "1.0.0"), "manifest is that of"), (MANIFEST.format("q", "1.0.0").replace("abi_version = 3", "abi_version = 4"), "ABI 4"), (MANIFEST.format("q", "1.0.0").replace("abi_version = 3\n", ""), "ABI None"), (MANIFEST.format("q", "1.0.0").replace("plugin.py", "../../victim/kept"), "plain name"), (MANIFEST.format("q", "1.0.0").replace("plugin.py", "plugin.toml"), "place")):
        (tmp_path / "site/q.toml").write_text(manifest)
        with pytest.raises(ValueError, match=why):
            plugin_store.place(entry, str(here))
    (tmp_path / "site/q.toml").write_text(MANIFEST.format("q", "1.0.0"))
    with pytest.raises(ValueError, match="checksum"):
        plugin_store.place({**entry, "wasm_sha256": "0"}, str(here))
    (here / "q").mkdir(parents=True)
    (here / "q/mine").write_text("x")
    with pytest.raises(ValueError, match="no plugin's folder"):
        plugin_store.place(entry, str(here))
    (here / "q").rename(here / "moved")
    (here / "q").symlink_to(victim)
    with pytest.raises(ValueError, match="no plugin's folder"):
        plugin_store.place(entry, str(here))
    (here / "q").unlink()
    for _ in range(2):
        assert plugin_store.place(entry, str(here)) == str(here / "q")
    assert sorted(os.listdir(here)) == ["moved", "q"] and os.listdir(victim) == ["kept"]


HANGS = """
import sys
calls = 0

def extract(source, options):
    global calls
    calls += 1
    act = source.text
    if act == "hang":
        while True:
            pass
    if act == "die":
        import os
        os._exit(1)
    if act == "raise":
        raise KeyError("odd")
    if act == "exit":
        sys.exit(0)
    if act in ("write", "spawn", "net", "remove", "list", "read"):
        import os, socket, subprocess
        {"write": lambda: open("/tmp/x", "w"), "spawn": lambda: subprocess.run(["true"]), "net": lambda: socket.socket(), "remove": lambda: os.remove("/tmp/x"), "list": lambda: os.listdir("/etc"), "read": lambda: open("/etc/passwd")}[act]()
    if act == "fill":
        return [Tag("x" * (1 << 31), 0)]
    if act == "nonsense":
        return [Tag("a", "b")]
    if act == "bytes":
        return [Tag(b"a", 0)]
    import fractions, json
    sys.stdout.write("noise")
    return [Tag(act, 0, "k", [("calls", str(calls)), ("on", ",".join(sorted(options.kinds)))], 3)]
"""


def test_modules_run_in_processes_with_limits():
    from tagloom.extract.base import Options, Source
    from tagloom.extract.sandbox import Limits, PluginFailed, PluginProcess

    plugin = PluginProcess(HANGS, Limits(seconds=8.0, memory=256 << 20))
    ask = lambda text: plugin.extract(Source(text), Options(frozenset("ab")))

    def fails(text, why):
        with pytest.raises(PluginFailed, match=why):
            ask(text)

    try:
        assert [(t.name, t.row, t.kind, t.fields, t.end) for t in ask("é")] == [("é", 0, "k", [("calls", "1"), ("on", "a,b")], 3)]
        for text, why in (("raise", "KeyError"), ("exit", "SystemExit"), ("write", "PermissionError"), ("spawn", "PermissionError"), ("net", "PermissionError"), ("remove", "PermissionError"), ("list", "PermissionError"), ("read", "PermissionError"), ("fill", "MemoryError"), ("nonsense", "no tag"), ("bytes", "TypeError")):
            fails(text, why)
        first = plugin.process.pid
        assert ask("x")[0].fields[0] == ("calls", "13")  # the process outlived them all
        fails("die", "its process ended")
        assert ask("x")[0].fields[0] == ("calls", "1") and plugin.process.pid != first
        large = "é\n" * 2_000_000
        assert len(plugin.extract(Source(large), Options())[0].name) == len(large)
        started = time.time()
        plugin.limits = Limits(seconds=1.0)
        fails("hang", "took more than 1 s")
        assert time.time() - started < 6 and plugin.process is None
    finally:
        plugin.close()
    broken = PluginProcess("def extract(", Limits(seconds=8.0))
    for _ in range(2):
        with pytest.raises(PluginFailed, match="SyntaxError"):
            broken.extract(Source("x"), Options())
    assert broken.process is None
    empty = PluginProcess("", Limits(seconds=8.0))
    with pytest.raises(PluginFailed, match="KeyError"):
        empty.extract(Source("x"), Options())
    empty.close()


def test_a_hanging_module_gives_error_rows(spark):
    from dataclasses import replace

    from tagloom.extract.sandbox import Limits

    texts = ["ok", "hang", "die", "fine", None, "\0"]
    files = spark.createDataFrame([(i, f"f{i}", "odd", t and t.encode(), "/nowhere") for i, t in enumerate(texts)], "file_ord long, rel_path string, lang string, content binary, path string")
    job = replace(job_of(Config()), modules={"odd": HANGS}, limits=Limits(seconds=2.0))
    rows = {r["file_ord"]: (r["name"], r["error"]) for r in extract_tags(files.coalesce(1), job).collect()}
    assert rows[0] == ("ok", None) and rows[3] == ("fine", None) and rows[5] == ("\0", None) and len(rows) == 6
    assert "2 s" in rows[1][1] and "ended" in rows[2][1] and rows[4][1].startswith("FileNotFoundError")
