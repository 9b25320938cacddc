"""Java: types, members, locals and annotation elements, with dotted scope paths."""

from __future__ import annotations

from .base import Lexer, Options, Source, Stream, Tag

LEXER = Lexer(
    [
        ("id", r"[^\W\d][\w$]*"),
        ("skip", r"//[^\r\n]*"),
        ("skip", r"/\*.*?(?:\*/|\Z)"),
        ("str", r"\"\"\".*?\"\"\"|\"(?:\\.|[^\\\"\r\n])*\"?|'(?:\\.|[^\\'\r\n])*'?"),
        ("num", r"\d[\w.]*"),
        ("op", r"->|::|\.\.\.|[-+*/%&|^=!<>]=|&&|\|\|"),
    ]
)
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
TYPES = {"class": ("c", "class"), "record": ("c", "class"), "interface": ("i", "interface"), "enum": ("g", "enum")}
STATEMENTS = {"return", "throw", "new", "if", "for", "while", "switch", "case", "do", "else", "try", "catch", "finally", "break", "continue", "yield", "assert", "import", "package", "instanceof", "this", "super", "goto", "synchronized"}


class _Walk:
    def __init__(self, src: Source, opt: Options):
        self.s, self.opt, self.tags = Stream(src, LEXER), opt, []
        self.scopes: list[tuple[str, str]] = []

    def tag(self, name: str, kind: str, i: int, last: int, file: bool = False, scoped: bool = True) -> None:
        if kind not in self.opt.kinds or not name:
            return
        fields = []
        if self.opt.on("end") and self.s.end_row(last) > self.s.row(i):
            fields.append(("end", str(self.s.end_row(last) + 1)))
        own = [("file", "")] if file else []
        if scoped and self.scopes and self.opt.scope:
            own.append((self.scopes[-1][0], ".".join(n for _, n in self.scopes)))
        self.tags.append(Tag(name, self.s.row(i), kind, fields + sorted(own)))

    def run(self) -> list[Tag]:
        self.members(0, len(self.s), "")
        return self.tags

    def modifiers(self, i: int) -> tuple[int, list[str]]:
        """After annotations and modifiers."""
        s, words = self.s, []
        while True:
            if s.text(i) == "@" and s.text(i + 1) != "interface":
                i += 2
                while s.text(i) == ".":
                    i += 2
                if s.text(i) == "(":
                    i = s.skip(i)
            elif s.text(i) in MODIFIERS and s.text(i + 1) not in ("->", "(", ":"):
                words.append(s.text(i))
                i += 1
            else:
                return i, words

    def name_after_type(self, i: int, end: int) -> int:
        """Index of the name that follows a type at i, or -1."""
        s = self.s
        if s.kind(i) != "id" or s.text(i) in STATEMENTS:
            return -1
        k = i + 1
        while True:
            if s.text(k) == "<":
                n = s.angles(k, end)
                if n == k:
                    return -1
                k = n
            elif s.text(k) == "." and s.kind(k + 1) == "id":
                k += 2
            elif s.text(k) == "[" and s.close[k] == k + 1:
                k += 2
            elif s.text(k) == "...":
                k += 1
            else:
                return k if s.kind(k) == "id" and s.text(k) not in STATEMENTS else -1

    def members(self, i: int, end: int, owner: str) -> None:
        s = self.s
        while i < end:
            start = i
            i, words = self.modifiers(i)
            t = s.text(i)
            if t == "package" and not self.scopes:
                stop = s.find(i, end, {";"})
                self.tag(s.span(i + 1, stop - 1), "p", i + 1, stop, scoped=False)
                i = stop + 1
            elif t == "import":
                i = s.find(i, end, {";"}) + 1
            elif t == "@" and s.text(i + 1) == "interface":
                i = self.type(i + 1, end, start, "a", "annotation")
            elif t in TYPES and s.kind(i + 1) == "id" and (t != "record" or s.text(i + 2) in ("(", "<")):
                i = self.type(i, end, start, *TYPES[t])
            elif t == "{":
                self.body(i + 1, s.close[i])
                i = s.close[i] + 1
            elif t in (";", ",", "}"):
                i += 1
            else:
                i = self.member(i, end, start, words, owner)

    def type(self, i: int, end: int, start: int, kind: str, key: str) -> int:
        s, name = self.s, self.s.text(i + 1)
        brace = s.find(i + 2, end, {"{", ";"})
        if brace >= end or s.text(brace) == ";":
            return min(brace + 1, end)
        close = s.close[brace]
        self.tag(name, kind, i + 1, close)
        # a record that is not wanted is no scope either
        if s.text(i) == "record" and kind not in self.opt.kinds:
            self.members(brace + 1, close, name)
            return close + 1
        self.scopes.append((key, name))
        inner = brace + 1
        if key == "enum":
            stop = s.find(inner, close, {";"})
            for a, b in s.parts(inner, stop):
                a, _ = self.modifiers(a)
                if s.kind(a) == "id":
                    self.tag(s.text(a), "e", a, b - 1, file=True)
                    for k in range(a, b):
                        if s.text(k) == "{":
                            self.members(k + 1, s.close[k], name)
                            break
            inner = stop + 1
        self.members(inner, close, name)
        self.scopes.pop()
        return close + 1

    def member(self, i: int, end: int, start: int, words: list[str], owner: str) -> int:
        s = self.s
        if s.text(i) == "<":
            i = max(s.angles(i, end), i + 1)
        if s.kind(i) == "id" and s.text(i) == owner and s.text(i + 1) in ("(", "{"):
            name, k = i, i + 1
        else:
            name = self.name_after_type(i, end)
            k = name + 1
        if name < 0:
            return max(s.skip(i), start + 1)
        if s.text(k) in ("(", "{"):
            stop = s.find(k, end, {"{", ";", "default"} if s.text(k) == "(" else {"{"})
            element = self.scopes and self.scopes[-1][0] == "annotation"
            if s.text(stop) == "default":
                stop = s.find(stop, end, {";"})
                if element:
                    self.tag(s.text(name), "m", name, stop)
                    self.tag(s.text(name), "f", name, stop)
                    return stop + 1
            last = s.close[stop] if s.text(stop) == "{" else stop
            self.tag(s.text(name), "m", name, last)
            if s.text(stop) == "{":
                self.scopes.append(("method", s.text(name)))
                self.body(stop + 1, last)
                self.scopes.pop()
            return last + 1
        stop = s.find(k, end, {";"})
        for a, b in s.parts(name, stop):
            self.tag(s.text(a), "f", a, b - 1, file="private" in words)
        self.body(k, stop)
        return stop + 1

    def body(self, i: int, end: int) -> None:
        """Local types and variables of code."""
        s, fresh = self.s, True
        while i < end:
            t = s.text(i)
            if fresh:
                k, _ = self.modifiers(i)
                if s.text(k) in TYPES and s.kind(k + 1) == "id" and s.text(k + 2) in ("{", "<", "extends", "implements", "("):
                    i = self.type(k, end, i, *TYPES[s.text(k)])
                    continue
                name = self.name_after_type(k, end)
                if name > 0 and s.text(name + 1) in ("=", ";", ",", ":", "["):
                    stop = s.find(name, end, {";", ":"})
                    for a, b in s.parts(name, stop):
                        self.tag(s.text(a), "l", a, b - 1, scoped=False)
                    i, fresh = name + 1, False
                    continue
            if t in ("new",) and s.kind(i + 1) == "id":
                k = s.find(i + 1, end, {"(", ";", ","})
                if s.text(k) == "(" and s.text(s.close[k] + 1) == "{":
                    brace = s.close[k] + 1
                    self.members(brace + 1, s.close[brace], "")
                    i, fresh = s.close[brace] + 1, False
                    continue
            fresh = t in ("{", "}", ";", "(", "->", ")", ":")
            i += 1


def extract(src: Source, opt: Options) -> list[Tag]:
    return _Walk(src, opt).run()
