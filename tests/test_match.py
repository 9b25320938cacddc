"""Tree patterns as joins, against a plain recursive matcher."""

import re

import pytest

from tagloom.extract.tree import DECLARATIONS, nodes_of, type_regex
from tagloom.operators.match import definitions, match, node_table
from tagloom.plans.patterns import PatternError, captures_of, parse_patterns

SOURCES = {
    "kotlin": 'class A<T>(val x: Int) : B() {\n  fun <T> List<T>.go(a: Int): Int = 1\n  val y = "s"\n  fun two() { fun inner() { go(y, 2) } }\n}\nobject O { }\n',
    "python": "class A(B):\n    x = 1\n\n    def f(self, y=[1, 2]):\n        return g(y)\n\n\ndef g(a): return {'k': a}\n",
    "go": "func (r *T) Do(a int) error {\n  x := f(a, 2)\n}\nfunc f(a, b int) { }\ntype P struct {\n  x int\n}\n",
    "java": "public class A {\n  int f(int a) { if (a > 0) { return g(a); } }\n  void g(int b) throws E { new Q() { void h() { } }; }\n}\n",
    "rust": "pub fn f<T>(x: T) -> u8 { 1 }\nimpl A { fn g(&self) { h(2) } fn i() {} }\nstruct S;\nmod m { const C: u8 = 3; }\n",
    "lua": "function a.b(x)\n  if x then y() end\nend\nlocal function d(z) return z end\n",
    "c++": "namespace n {\nclass C : D { int f(int a) { return a; } };\n}\nint main() { }\n((( ]\n",
}
PATTERNS = [
    "(_ name: (_) @name) @definition.any",
    "(_ name: (identifier) @name parameters: (parameters) @p body: (block) @b) @definition.f",
    "(_ body: (block (_ name: (_) @inner)) @b) @definition.outer",
    "(parameters . (_) @first)",
    "(parameters (_) @last .)",
    "(parameters (identifier) @a . (identifier) @b)",
    "[(string) (number)] @literal",
    "(_ name: [(identifier) (number)] @name !body) @definition.bodiless",
    '((_ name: (_) @name) @definition.x (#match? @name "^[a-g]$"))',
    '((_ name: (_) @name parameters: (_)? @p) (#not-eq? @name "f"))',
    '((_ name: (_) @n) (#any-of? @n "A" "g" "P"))',
    '("return" @r)',
    "(argument_list (number)+ @n)",
    "(_ (identifier) @x (identifier) @y)",
    "((_ name: (_) @a body: (_ (_ name: (_) @b))) (#eq? @a @b))",
]


def brute(nodes, p):
    """(id, {(capture, id)}) of every way a pattern holds."""
    below = {}
    for n in nodes:
        below.setdefault(n[1], []).append(n)
    text = {n[0]: n[5] for n in nodes}

    def ways(n, p):
        if p.field and n[4] != p.field:
            return
        own = frozenset((c, n[0]) for c in p.captures)
        if p.options:
            for option in p.options:
                yield from (own | w for w in ways(n, option))
            return
        if p.type is not None and n[3] not in (p.type, type_regex(p.type) or p.type) and not (p.token and n[5] == p.type):
            return
        children = below.get(n[0], [])
        if any(c[4] == a for c in children for a in p.absent):
            return
        partial = [(-1, own)]
        for want in p.children:
            found = []
            for at, held in partial:
                more = [(c[2], held | w) for c in children if (c[2] == at + 1 if want.adjoins else c[2] > at) and not (want.closes and c[2] != max(x[2] for x in children)) for w in set(ways(c, want))]
                found += more or ([(at, held)] if want.quantifier in ("?", "*") else [])
            partial = found
        for _, held in partial:
            said = dict(held)
            if all(holds(name, args, said) for name, *args in p.predicates):
                yield held

    def holds(name, args, said):
        one = text.get(said.get(args[0][1:]))
        if name in ("#eq?", "#not-eq?"):
            other = text.get(said.get(args[1][1:])) if args[1].startswith("@") else args[1]
            return (one == other) == (name == "#eq?")
        if name in ("#match?", "#not-match?"):
            return (one is not None and re.search(args[1], one) is not None) == (name == "#match?")
        return one in args[1:]

    return sorted((n[0], tuple(sorted(w))) for n in nodes for w in ways(n, p))


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame([(i, lang, text.encode()) for i, (lang, text) in enumerate(SOURCES.items())] + [(90, "kotlin", b""), (91, "kotlin", b"\xff"), (92, "kotlin", None), (93, "klingon", b"x"), (94, None, b"x")], "file_ord long, lang string, content binary")
    return node_table(files).cache()


def test_nodes(nodes):
    rows = [tuple(r) for r in nodes.collect()]
    for i, (lang, text) in enumerate(SOURCES.items()):
        mine = sorted(r[2:9] for r in rows if r[0] == i)
        assert mine == list(nodes_of(text, lang)) and [r[0] for r in mine] == list(range(len(mine)))
        assert all(r[1] < r[0] and (lines := text.split("\n"))[r[6]] is not None and (not r[5] or r[5] in lines[r[6]]) for r in mine[1:])
    assert sorted((r[0], r[5]) for r in rows if r[0] >= 90) == [(90, "source"), (91, "error"), (92, "error")]


@pytest.mark.parametrize("number", range(len(PATTERNS)))
def test_patterns_against_recursion(nodes, number):
    [p] = parse_patterns(PATTERNS[number])
    got = {}
    for r in match(nodes, [p]).collect():
        got.setdefault(r["file"], []).append((r["id"], tuple(sorted((c["name"], c["id"]) for c in r["captures"]))))
    total = 0
    for i, (lang, text) in enumerate(SOURCES.items()):
        want = brute(list(nodes_of(text, lang)), p)
        assert sorted(set(got.get(i, []))) == sorted(set(want)), (lang, PATTERNS[number])
        total += len(want)
    assert total or number == 14


def test_definitions(nodes):
    found = definitions(nodes, parse_patterns(PATTERNS[0] + '(string) @reference.s (_ parameters: (_) @name) @reference.call'))
    names = {}
    for r in found.orderBy("file", "id").collect():
        names.setdefault(r["file"], []).append(r["name"])
    assert names[0] == ["A", "x", "go", "y", "two", "inner", "O"] and names[1] == ["A", "f", "g"] and names[2] == ["Do", "f", "P"]
    assert names[3] == ["A", "f", "g", "h"] and names[4] == ["f", "A", "g", "i", "S", "m", "C"] and names[5] == ["b", "d"] and names[6] == ["n", "C", "f", "main"]
    assert definitions(nodes, parse_patterns("(string) @reference.s")).count() == 0


def test_odd_sources():
    for lang in DECLARATIONS:
        for text in ("", "(", "}" * 5, "fun", "class", "def f(", "func (", "\n" * 10, "function\n", "type type type", "{" * 3_000 + "x", "class A {" * 500, "fn " * 100):
            got = list(nodes_of(text, lang))
            assert [n[0] for n in got] == list(range(len(got))) and all(n[1] < n[0] for n in got)


def test_reading_of_queries():
    text = '; note\n((f/g name: (_)? @a . [(x) "y\\n"]+ @b.c !z .) @definition.f (#match? @a "^\\\\d") (#set! k "v")) "tok" @t'
    one, two = parse_patterns(text)
    assert one.type == "f/g" and one.absent == ("z",) and captures_of(one) == ["definition.f", "a", "b.c"]
    assert one.children[0].quantifier == "?" and one.children[1].adjoins and one.children[1].closes and one.children[1].options[1].type == "y\n"
    assert one.predicates == (("#match?", "@a", "^\\d"), ("#set!", "k", "v")) and two.token and two.captures == ("t",)
    for bad in ("(a", ")", "(a (b) @", "{", "((a) (b))"):
        with pytest.raises(PatternError):
            parse_patterns(bad)


def test_any_node_as_root_needs_no_join(spark):
    nodes = node_table(spark.createDataFrame([(0, "go", SOURCES["go"].encode())], "file_ord long, lang string, content binary")).localCheckpoint()
    plan = lambda text: match(nodes, parse_patterns(text))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("(_ parameters: (_) @p)")
    assert plan("(_ . (_ (identifier) @a))").count("Join") == 1
    first = match(nodes, parse_patterns("(_ . (_) @x)")).collect()
    assert {(r["id"], r["captures"][0]["id"]) for r in first} == {(n[1], n[0]) for n in nodes_of(SOURCES["go"], "go") if n[1] >= 0 and n[2] == 0}
