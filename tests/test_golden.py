"""Cases of a folder that GOLDEN_CASES names: ``<group>/<case>/input`` with args.txt, ``expected`` with stdout.txt and exit_code.txt.

Skipped where it is unset. ``{...}`` in arguments stands for folders of plugins, which such cases need; they are skipped.
"""

import glob
import os
import shlex

import pytest

from tagloom import cli

ROOT = os.environ.get("GOLDEN_CASES", "")
CASES = sorted(os.path.dirname(os.path.dirname(p)) for p in glob.glob(f"{ROOT}/*/*/input/args.txt")) if ROOT else []


def read(path, default=""):
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("case", CASES, ids=lambda c: os.path.relpath(c, ROOT))
def test_case(spark, case, monkeypatch, capsys, tmp_path):
    args = read(f"{case}/input/args.txt")
    if "{" in args:
        pytest.skip("needs plugins")
    monkeypatch.chdir(f"{case}/input")
    argv = ["--plugins-dir", "/nonexistent", *shlex.split(args)]
    if os.path.exists("user_grammar.toml"):
        query = f'query_file_path = "{case}/input/queries.scm"\n' if os.path.exists("queries.scm") else ""
        (tmp_path / "u.toml").write_text("[[user_grammars]]\n" + query + read("user_grammar.toml"))
        argv += ["--user-languages-config", str(tmp_path / "u.toml")]
    code = cli.main(argv)
    out = capsys.readouterr().out
    plain = lambda s: [x.rstrip() for x in s.rstrip().split("\n")]
    assert code == int(read(f"{case}/expected/exit_code.txt", "0") or 0)
    assert plain(out) == plain(read(f"{case}/expected/stdout.txt"))
