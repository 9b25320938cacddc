import pytest

from tagloom import config as c
from tagloom.plans.languages import Edit, UnknownLanguage, build_registry, kinds_of

RUST = kinds_of("rust")


@pytest.mark.parametrize(
    "spec, want",
    [
        ("", "nsguicfPmeTCvtM"),
        ("sf", "sf"),
        ("+l-s", "nguicfPmeTCvtM"),
        ("struct,function", "sf"),
        ("-struct,+enum", "nguicfPmeTCvtM"),
        ("variant,", "e"),
    ],
)
def test_kinds(spec, want):
    assert c.parse_kinds(spec, RUST) == set(want)


def test_unknown_kind_letters_only_warn(capsys):
    assert c.parse_kinds("sZ", RUST) == {"s"} and "unknown kind: Z" in capsys.readouterr().err


def test_typescript_constants_stand_for_another_kind():
    assert c.parse_kinds("C", kinds_of("typescript")) == {"p"}


@pytest.mark.parametrize(
    "spec, on, off",
    [
        ("", {"scope", "typeref"}, {"line", "roles"}),
        ("nS", {"line", "signature", "scope"}, {"kind"}),
        ("+line,-scope", {"line"}, {"scope"}),
        ("-r", {"roles"}, set()),
        ("+n+k", set(), {"line", "kind"}),
        ("x", {"scope"}, set()),
    ],
)
def test_fields(spec, on, off):
    got = c.parse_fields(spec)
    assert on <= got and not off & got


def test_extras():
    assert c.parse_extras("+q,-F") == c.Extras(True, False)
    assert c.parse_extras("+fileScope") == c.Extras(False, True)
    assert c.parse_extras("qualified") == c.Extras()


def test_map_items():
    assert c.map_item("L", ".x") == Edit("L", "add", "ext", "x")
    assert c.map_item("L", "-(*.y)") == Edit("L", "remove", "pattern", "*.y")
    assert c.map_item("L", r"%a\%b%i") == Edit("L", "add", "regex", "(?i)a%b")
    assert c.map_item("L", "%(%") is None
    assert c.langmap("c:.a.b,go:+(X*)") == [Edit("c", "clear"), Edit("c", "add", "ext", "b"), Edit("c", "add", "ext", "a"), Edit("go", "add", "pattern", "X*")]


def test_arguments(tmp_path):
    opts = tmp_path / "o.ctags"
    opts.write_text("# comment\n\n--sort=no\n--kinds-rust=s\n")
    ex = tmp_path / "ex"
    ex.write_text("*.o\n")
    a = c.parse_args([f"--options={opts}", "--kinds-rust", "f", "--go-kinds=p", "--append", "x.rs", f"--exclude=@{ex}", "--map-python=.zz", "-f", "-", "y.rs"])
    assert not a.sort and a.append and a.kinds == {"rust": "f", "go": "p"}
    assert a.files == ["x.rs", "y.rs"] and a.excludes == [f"@{ex}", "*.o"] and a.tag_file == "-"
    assert a.edits == [Edit("python", "add", "ext", "zz")]
    assert c.parse_args(["--list-kinds"]).command == "list_kinds" and c.parse_args(["--list-maps", "go"]).argument == "go"
    assert c.parse_args(["--sort=no", "--max-parallelism", "--workers", "2"]).workers >= 1


def test_registry():
    r = build_registry()
    assert r.ext["h"] == ["c", "c++"] and r.ext["H"] == ["c++"] and r.named("Python-mode") == "python" and r.named("cpp") == "c++"
    assert build_registry(edits=[Edit("c", "remove", "ext", "h")]).ext["h"] == ["c++"]
    assert build_registry(edits=[Edit("rust", "add", "ext", "go")]).ext["go"] == ["rust", "go"]
    assert "rs" not in build_registry(edits=[Edit("rust", "clear")]).ext
    assert build_registry(force="golang").forced == "go"
    for bad in ({"force": "nope"}, {"edits": [Edit("nope", "add", "ext", "x")]}):
        with pytest.raises(UnknownLanguage):
            build_registry(**bad)
