"""Small sources and the tags they must give, by name, kind and fields."""

import sys

import pytest

from tagloom.config import Config, parse_args
from tagloom.extract.base import Options, Source, djb2, split_lines
from tagloom.functions import modeline as m
from tagloom.operators.extract import address, job_of, tags_of
from tagloom.queries import SOURCES


def tags(lang, text, *argv, name="x", plugins=frozenset()):
    job = job_of(parse_args(list(argv)) if argv else Config(), plugins)
    return [(t.name, t.kind, ";".join(f"{k}={v}" for k, v in t.fields)) for t, _ in tags_of(text.encode(), name, lang, job)]


def test_lines():
    assert split_lines("a\r\nb\rc\n\nd\n") == ["a", "b", "c", "", "d"] and split_lines("") == []


def test_addresses():
    assert address(["a/b^c$\\"], 0, "native") == '/^a\\/b\\^c\\$\\\\$/;"'
    assert address([], 4, "native") == "/^5$/;"
    long = "é" * 60
    assert address([long], 0, "plugin") == "/^" + "é" * 48 + '/;"' and address(["x  "], 0, "query") == '/^x$/;"\t'
    assert address(["x" * 95 + "/y"], 0, "plugin") == "/^" + "x" * 95 + '\\/;"'


def test_python():
    got = tags("python", "class A:\n    x = 1\n    def f(self) -> int:\n        y = 2\n    @dec\n    def g(self): pass\nfrom m import a as b, c\nh = lambda q: q\nu, v.w = 1, 2\nif 1:\n    k: str = ''\n", "--kinds-python=+l")
    assert got == [
        ("A", "c", ""),
        ("x", "v", "class=A"),
        ("f", "m", "typeref=typename:int;class=A"),
        ("y", "l", "function=f"),
        ("g", "m", "class=A"),
        ("g", "f", "function=g"),
        ("b", "Y", "nameref=module:m.a"),
        ("h", "f", "signature=(q)"),
        ("u", "v", ""),
        ("k", "v", "typeref=typename:str"),
    ]


def test_python_strings_and_brackets_hide_code():
    assert tags("python", 's = """\nclass No: pass\n"""\nd = {\n"a": 1,\n}\ndef f(a=(1,\n 2)): return """x"""\n') == [("s", "v", ""), ("d", "v", ""), ("f", "f", "")]


def test_rust():
    src = "mod a { pub struct S<T> { pub x: Vec<T>, y: u8 } impl<T> D for S<T> { type O = u8; const K: u8 = 1; fn f<'a>(&'a self) -> u8 where T: X { 1 } } trait T { type A; fn g(); } }\nunion U { a: u8 }\nmacro_rules! mm { () => {} }\nstatic mut Z: u8 = 1;\nfn main() { let s = \"struct No {}\"; let p = *const_x; }\n"
    assert tags("rust", src) == [
        ("a", "n", ""),
        ("S", "s", "module=a"),
        ("x", "m", "module=a;struct=S"),
        ("y", "m", "module=a;struct=S"),
        ("S<T>", "c", "module=a;trait=D"),
        ("O", "t", "implementation=S<T>;module=a"),
        ("K", "C", "implementation=S<T>;module=a"),
        ("f", "P", "implementation=S<T>;module=a"),
        ("T", "i", "module=a"),
        ("A", "T", "interface=T;module=a"),
        ("g", "m", "interface=T;module=a"),
        ("U", "u", ""),
        ("mm", "M", ""),
        ("Z", "v", ""),
        ("main", "f", ""),
    ]


def test_go_methods_belong_to_the_last_type_of_a_group():
    src = "package p\ntype (\n\tA interface { One() }\n\tB interface { Two() }\n)\ntype (\n\tC interface { Three() }\n\tD struct { x int }\n)\ntype (\n\tE interface { Four() }\n\tF int\n)\ntype G interface { Five() }\n"
    found = [(n, k, f) for n, k, f in tags("go", src) if k in "nism"]
    assert found == [("A", "i", "package=p"), ("B", "i", "package=p"), ("One", "n", "interface=p.B"), ("Two", "n", "interface=p.B"), ("C", "i", "package=p"), ("D", "s", "package=p"), ("x", "m", "struct=p.D;typeref=typename:int"), ("E", "i", "package=p"), ("G", "i", "package=p"), ("Five", "n", "interface=p.G")]


def test_go():
    src = "package p\nimport q \"a/b\"\nvar x, y = 1, 2\nfunc (r *T[K]) M(a int) (int, error) {\n\tz := 1\n\t_, w := f()\n}\ntype (\n\tI interface {\n\t\tDo(x int) string\n\t}\n)\n"
    assert tags("go", src) == [
        ("p", "p", ""),
        ("q", "P", "package=a/b"),
        ("x", "v", "package=p"),
        ("y", "v", "package=p"),
        ("M", "f", "struct=p.T;typeref=typename:(int, error)"),
        ("z", "v", "package=p"),
        ("w", "v", "package=p"),
        ("I", "i", "package=p"),
        ("Do", "n", "interface=p.I;typeref=typename:string"),
    ]


def test_c_and_cpp():
    assert tags("c", "typedef struct { int a; } T;\nstatic const unsigned long n = 1;\nint *hidden(void) { return 0; }\nint arr[3];\nenum { X };\n", name="source.c") == [
        ("__anon16f8bb470208", "s", ""),
        ("a", "m", "struct=__anon16f8bb470208;typeref=typename:int"),
        ("T", "t", "typeref=struct:__anon16f8bb470108"),
        ("n", "v", "typeref=typename:unsigned long"),
    ]
    got = tags("c++", "namespace n { class C : public B { C(); int f() const; T x; }; }\nint n::C::f() const { int l = 0; }\ntemplate <typename T> T id(T t) { return t; }\n", "--kinds-c++=+lpnZz")
    assert ("n", "n", "") in got and ("C", "p", "class=C;namespace=n") in got and ("l", "l", "function=f;typeref=typename:int") in got
    assert ("T", "Z", "") in got and ("t", "z", "typeref=typename:T;function=id") in got


def test_javascript():
    got = tags("javascript", "a.b = { c: 1, d() {} };\nfunction* g() {}\n(function () { var i = 1; })();\nlet { x } = y, z = () => 1;\nconst re = /function no() {}/;\n", name="source.js")
    assert got == [
        ("b", "p", ""),
        ("c", "p", "property=a.b"),
        ("d", "m", "property=a.b"),
        ("g", "g", ""),
        ("anonymousFunctionf610258101", "f", ""),
        ("i", "v", "function=anonymousFunctionf610258101"),
        ("z", "f", ""),
        ("re", "C", ""),
    ]


def test_typescript():
    got = tags("typescript", "export class A<T> { constructor(private readonly s: string) {} static m?(): void; p: number = 1 }\nmodule M { interface I { a?: string; b(): void } }\nconst K = 1;\nenum E { X = 1, Y }\n")
    assert got == [
        ("A", "c", ""),
        ("constructor", "m", "class=A"),
        ("s", "p", "function=constructor"),
        ("m", "m", "class=A"),
        ("p", "p", "class=A"),
        ("M", "n", ""),
        ("I", "i", "module=M"),
        ("a", "p", "interface=I"),
        ("b", "m", "interface=I"),
        ("E", "g", ""),
        ("X", "e", "enum=E"),
        ("Y", "e", "enum=E"),
    ]


def test_java_by_plugin_and_by_rules():
    src = "package a.b;\nclass A { private int x, y; void f() { int z = 1; } enum E { P { void q() {} }, Q } }\n"
    assert tags("java", src, "--kinds-java=+l", plugins=frozenset({"java"})) == [
        ("a.b", "p", ""),
        ("A", "c", ""),
        ("x", "f", "class=A;file="),
        ("y", "f", "class=A;file="),
        ("f", "m", "class=A"),
        ("z", "l", ""),
        ("E", "g", "class=A"),
        ("P", "e", "enum=A.E;file="),
        ("q", "m", "enum=A.E"),
        ("Q", "e", "enum=A.E;file="),
    ]
    assert ("A", None, "") in tags("java", src)


def test_kotlin():
    got = tags("kotlin", "package k\ndata class C(val a: Int, b: Int)\nobject O { val f = { x: Int -> x } }\nfun Int.g() = list.map { it }\n", plugins=frozenset({"kotlin"}))
    assert [t[:2] for t in got] == [("k", "p"), ("C", "c"), ("a", "C"), ("O", "o"), ("f", "C"), ("x", "m"), ("g", "m"), ("<lambda>", "m")]
    assert got[5][2] == "method=k.O.f"


@pytest.mark.parametrize("lang", ["python", "rust", "go", "c", "c++", "javascript", "typescript", "java", "kotlin", "ruby", "shell", "c#", "julia", "scala", "gleam", "php", "lua", "elixir", "ocaml"])
def test_odd_input_is_survived(lang):
    odd = ["", "\n", "}{)(][", "class", "def f(", "fn", "func (", "struct {", "/* never ends", '"never ends', "template <", "#define", "a" * 5000, "((" * 2000, "é\u2028\t\x00"]
    for text in odd:
        tags(lang, text, plugins=frozenset({"java", "kotlin"}))


def test_invalid_utf8_raises():
    with pytest.raises(UnicodeDecodeError):
        list(tags_of(b"\xff\xfe", "x", "python", job_of(Config())))


def test_modelines():
    assert m.vim_type("/* vim: set ft=c\\:x ts=4: */") and m.vim_type("# vim: ts=2:ft=ruby") == "ruby" and m.vim_type("novim: ft=x") is None
    assert m.emacs_first("-*- Perl -*-") == "Perl" and m.emacs_first("-*- a: b; mode: sh -*-") == "sh"
    assert m.modeline(b"x\n" * 3 + b"Local Variables:\nmode: python\nEnd:\n", b"") == "python"
    assert m.modeline(b"\xff\n" + b"x\n" * 20, b"# vi: syntax=go\n") == "go"


def test_hash():
    assert djb2("source.c") == "16f8bb47" and djb2("source.js") == "f6102581"
    assert Options().scope and Source("a\nb").row(2) == 1


def test_a_record_that_never_ends_takes_the_next_declaration():
    from tagloom.config import Config
    from tagloom.operators.extract import job_of, tags_of

    body = b"class A {\n  public record Broken(int a)\n  public void Lost() {}\n  public void Kept() {}\n  [Marked(1)]\n  public void Also() {}\n}\n"
    assert [t.name for t, _ in tags_of(body, "a.cs", "c#", job_of(Config()))] == ["A", "Broken", "Kept", "Also"]


def calls_for(lang, data):
    """Calls of functions, Python's and C's, that a file's tags take."""
    job, n = job_of(Config(), frozenset({"java", "kotlin"})), 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    list(tags_of(data, "x", lang, job))
    sys.setprofile(count)
    try:
        list(tags_of(data, "x", lang, job))
    finally:
        sys.setprofile(None)
    return n


#: Calls that the query's file of a language may take.
CALLS = {
    "rust": 480,
    "python": 500,
    "java": 370,
    "c": 440,
    "kotlin": 400,
    "typescript": 370,
    "go": 490,
}


@pytest.mark.parametrize("lang", CALLS)
def test_work_of_a_file(lang):
    """Large tables are as slow as a file is, and a file as its length."""
    data = SOURCES[lang][1].replace("{k}", "1").replace("{a}", "red").replace("{b}", "box").encode()
    assert calls_for(lang, data) < CALLS[lang]
    assert calls_for(lang, data * 40) < 2.1 * calls_for(lang, data * 20)


def test_slashes():
    """A slash begins a literal where a value may stand; what follows is read anew."""
    names = lambda text: [n for n, _, _ in tags("javascript", text)]
    assert names("a = b /c/ d; function f() {}\nlet r = /function g() {}/; function h() {}") == ["f", "r", "h"]
    assert names("x /= 2; var y = z /= 3; function k() {} // function n() {}\n/* function m() {} */ var q = [/[/]\"/, 1]") == ["y", "k", "q"]


def test_space_before_a_line_end():
    """Space at the end of a line does not join it with the next."""
    names = lambda lang, text: [n for n, _, _ in tags(lang, text, plugins=frozenset({"kotlin"}))]
    assert names("python", "X = 1 \nY = 2\t\r\nclass A: \n    Z = 3 \n\n    \n    W = 4\n") == ["X", "Y", "A", "Z", "W"]
    assert names("go", "package p \nvar x int \nvar y int\n\t\nfunc f() {} \nfunc g() {}\n") == ["p", "x", "y", "f", "g"]
    assert names("kotlin", "package q \nclass A(val b: Int) \nfun f() = 1 \nfun g() = 2\n") == ["q", "A", "b", "f", "g"]
