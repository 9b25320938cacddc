"""Behaviour that surprises and is kept: one small source each, by what is odd about it."""

import pytest

from tagloom.config import parse_args
from tagloom.operators.extract import job_of, tags_of


def tags(lang, text, *argv, plugins=()):
    """name, kind and fields of each tag."""
    job = job_of(parse_args([*argv, "x"]), frozenset(plugins))
    return [(t.name, t.kind, ";".join(f"{k}={v}" for k, v in t.fields)) for t, _ in tags_of(text.encode(), "a.x", lang, job)]


GROUP = "package p\ntype ( A interface { One() }; B %s )\n"
FUNCTION = "package p\nfunc F(a int) string { return \"\" }\n"
PLAIN = [("p", "p", "")]

CASES = {
    "a decorated definition comes twice, the second in its own scope": ("python", "@d\ndef f(): pass\n@d\nclass A: pass\n", (), [("f", "f", ""), ("f", "f", "function=f"), ("A", "c", ""), ("A", "c", "class=A")]),
    "constants and generators of TypeScript have kinds that no letter switches on": ("typescript", "const bar = 1;\nfunction* gen() {}\nlet v = 2;\n", (), [("v", "v", "")]),
    "the same, asked for": ("typescript", "const bar = 1;\nfunction* gen() {}\nlet v = 2;\n", ("--kinds-typescript=+C+G",), [("v", "v", "")]),
    "Go has neither kind: nor file:": ("go", "package p\n", ("--fields=+k,+f", "--extras=+F"), PLAIN),
    "a lambda takes the place of the tag before it that has its name": ("python", "def h(): pass\nh = lambda x: x\n", ("--kinds-python=-v",), [("h", "f", "signature=(x)")]),
    "where variables are tags, it is the variable's": ("python", "def h(): pass\nh = lambda x: x\n", (), [("h", "f", ""), ("h", "f", "signature=(x)")]),
    "a signature keeps its line feeds": ("python", "def f(a,\n      b): pass\n", ("--fields=+S",), [("f", "f", "signature=(a,\n      b)")]),
    "a record without its kind is no scope, a class is": ("java", "record R(int a) { void m() {} }\nclass C { void n() {} }\n", ("--kinds-java=m",), [("m", "m", ""), ("n", "m", "class=C")]),
    "file: of Rust is the path, by a field": ("rust", "fn f() {}\n", ("--fields=+f",), [("f", "f", "file=a.x")]),
    "and no extra": ("rust", "fn f() {}\n", ("--extras=+F",), [("f", "f", "")]),
    "file: of C is empty, by an extra": ("c", "int f(void) { return 1; }\n", ("--extras=+F",), [("f", "f", "file=;typeref=typename:int")]),
    "and of Python": ("python", "def f(): pass\n", ("--extras=+F",), [("f", "f", "file=")]),
    "and no field": ("python", "def f(): pass\n", ("--fields=+f",), [("f", "f", "")]),
    "typeref of Go switched off comes last": ("go", FUNCTION, ("--fields=+S,-t",), [*PLAIN, ("F", "f", "package=p;signature=(a int);typeref=typename:string")]),
    "typeref of Go switched off goes with the scope": ("go", FUNCTION, ("--fields=+S,-t,-s",), [*PLAIN, ("F", "f", "signature=(a int)")]),
    "methods of a group belong to its last type": ("go", GROUP % "interface { Two() }", (), [*PLAIN, ("A", "i", "package=p"), ("B", "i", "package=p"), ("One", "n", "interface=p.B"), ("Two", "n", "interface=p.B")]),
    "and are lost if that is no interface": ("go", GROUP % "int", (), [*PLAIN, ("A", "i", "package=p"), ("B", "t", "package=p;typeref=typename:int")]),
    "pointers and arrays of C are no variables": ("c", "int *f(void) { return 0; }\nint *p;\nint a[3];\nint n;\n", (), [("n", "v", "typeref=typename:int")]),
    "typeref of Python has no switch": ("python", "def f(a) -> int: pass\nx: str = 1\n", ("--fields=-t",), [("f", "f", "typeref=typename:int"), ("x", "v", "typeref=typename:str")]),
    "nor has that of C++": ("c++", "int v;\n", ("--fields=-t",), [("v", "v", "typeref=typename:int")]),
    "scopes of TypeScript go by their field alone": ("typescript", "class A { f() {} }\n", ("--fields=-s", "--extras=+q"), [("A", "c", ""), ("f", "m", "")]),
    "scopes of Rust go by their field or by qualified tags": ("rust", "impl T for A { fn f() {} }\n", ("--fields=-s", "--extras=+q"), [("A", "c", "trait=T"), ("f", "P", "implementation=A")]),
    "and what a trait or a variant adds goes with them": ("rust", "impl T for A { fn f() {} }\nenum E { V }\n", ("--fields=-s",), [("A", "c", ""), ("f", "P", ""), ("E", "g", ""), ("V", "e", "")]),
    "scopes of Python go by their field alone": ("python", "class A:\n    def f(self): pass\n", ("--fields=-s", "--extras=+q"), [("A", "c", ""), ("f", "m", "")]),
}


@pytest.mark.parametrize("case", CASES)
def test_quirk(case):
    lang, text, argv, want = CASES[case]
    assert tags(lang, text, *argv, plugins=("java",)) == want


def test_python_ends_and_rows_are_the_statements():
    """Assignments, lambdas and imports end with their last line and stand where they begin."""
    text = "from m import (a as b,\n    c as d)\nx, y = [\n 1,\n], 2\nf = lambda q: (\n q)\nclass A:\n    z = 1\n    def g(self):\n        return 1\n"
    job = job_of(parse_args(["--fields=+e,+n", "x"]))
    got = [(t.name, dict(t.fields)["line"], dict(t.fields)["end"]) for t, _ in tags_of(text.encode(), "a.py", "python", job)]
    assert got == [("b", "1", "2"), ("d", "1", "2"), ("x", "3", "5"), ("y", "3", "5"), ("f", "6", "7"), ("A", "8", "11"), ("z", "9", "9"), ("g", "10", "11")]
