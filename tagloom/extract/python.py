"""Python: logical lines by indentation (a tab reaches the next multiple of eight)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import Fields, Lexer, Options, Source, Stream, Tag

LEXER = Lexer(
    [
        # a name that cannot begin a string
        ("id", r"[^\W\drbuftRBUFT]\w*"),
        ("skip", r"\#[^\r\n]*"),
        ("skip", r"\\(?:\r\n|\r|\n)"),
        ("str", r"(?i:[rbuft]{0,2})(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\\\"\r\n])*\"?|'(?:\\.|[^\\'\r\n])*'?)"),
        ("id", r"[^\W\d]\w*"),
        ("num", r"\d[\w.]*"),
        ("op", r"->|:=|\*\*=|//=|>>=|<<=|[-+*/%&|^@!=<>]=|\.\.\."),
    ],
    newlines=True,
)
EQUAL, COLON, SEMICOLON = {"="}, {":"}, {";"}
BLOCKS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "match", "case"}


class _Walk:
    def __init__(self, src: Source, opt: Options):
        self.s, self.opt, self.tags = Stream(src, LEXER), opt, []
        self.scopes: list[tuple[str, str]] = []

    def tag(self, name: str, kind: str, i: int, extra: list[tuple[str, str]] = (), end: int | None = None) -> Tag | None:
        """A tag on the row of token ``i``; ``end`` is the last row of a statement that holds no block."""
        if kind not in self.opt.kinds or not name:
            return None
        o, f, row = self.opt, Fields(), self.s.row(i)
        if o.on("kind"):
            f.put("kind", kind)
        if o.on("line"):
            f.put("line", str(row + 1))
        access = "private" if kind == "l" else "protected" if name.startswith("_") and not name.endswith("__") else "public"
        f.put("access", access, o.on("access"))
        f.put("roles", "def", o.on("roles"))
        for k, v in extra:
            f.put(k, v)
        if o.on("scope"):
            inner = next(((k, n) for k, n in reversed(self.scopes) if k == "class"), None) if kind == "m" else (self.scopes[-1] if self.scopes else None)
            if inner:
                f.put(*inner)
        f.put("file", "", o.file_scope)
        f.put("end", str((end or 0) + 1), end is not None and o.on("end"))
        tag = Tag(name, row, kind, f.list(), end if end is not None else row)
        self.tags.append(tag)
        return tag

    def close_end(self, tag: Tag | None, row: int) -> None:
        if tag is not None and self.opt.on("end"):
            tag.fields.append(("end", str(row + 1)))

    def lines(self) -> Iterator[tuple[int, int, int]]:
        """(indent, first token, after last) of each logical line."""
        s, i, n = self.s, 0, len(self.s)
        kinds, close = s.kinds, s.close
        while i < n:
            if kinds[i] == "nl":
                i += 1
                continue
            line_start = s.src.starts[s.row(i)]
            lead = s.src.text[line_start : s.starts[i]]
            indent = 0
            for c in lead if "\t" in lead else ():
                indent = indent + 8 - indent % 8 if c == "\t" else indent + 1
            indent = indent or len(lead)
            j = i
            while j < n and kinds[j] != "nl":
                j = close[j] + 1 if close[j] >= 0 else j + 1
            yield indent, i, min(j, n)
            i = j

    def run(self) -> list[Tag]:
        blocks: list[tuple[int, int, list[Tag | None]]] = []  # indent of the header, scopes pushed, open tags
        pending = None  # rows of decorators above a definition
        last = 0
        for indent, i, j in self.lines():
            while blocks and indent <= blocks[-1][0]:
                _, pushed, tags = blocks.pop()
                for t in tags:
                    self.close_end(t, last)
                del self.scopes[len(self.scopes) - pushed :]
            if self.s.text(i) == "@":
                pending = indent
                last = self.s.end_row(j - 1)
                continue
            pushed, tags, opened = self.statement(i, j, pending is not None)
            pending = None
            last = self.s.end_row(j - 1)
            if opened:
                blocks.append((indent, pushed, tags))
            else:
                for t in tags:
                    self.close_end(t, last)
                del self.scopes[len(self.scopes) - pushed :]
        while blocks:
            _, pushed, tags = blocks.pop()
            for t in tags:
                self.close_end(t, last)
        return self.tags

    def statement(self, i: int, j: int, decorated: bool = False) -> tuple[int, list[Tag | None], bool]:
        """Scopes pushed, tags that the block's end closes, and whether a block of lines may follow."""
        s = self.s
        word = s.text(i)
        if word == "async" and s.text(i + 1) in ("def", "for", "with"):
            return self.statement(i + 1, j, decorated)
        if word in ("def", "class") and s.kind(i + 1) == "id":
            tags, pushed = [self.define(i, j)], 0
            self.scopes.append(("class" if word == "class" else "function", s.text(i + 1)))
            pushed += 1
            if decorated:  # once for the decorator, once for the definition below it
                tags.append(self.define(i, j))
                self.scopes.append(self.scopes[-1])
                pushed += 1
            colon = s.find(i, j, {":"})
            if colon + 1 < j:
                self.simple(colon + 1, j)
            return pushed, tags, True
        if word in BLOCKS:
            colon = s.find(i + 1, j, {":"})
            if colon < j and not (word in ("match", "case") and colon + 1 < j and s.text(i + 1) in ("=", ".", ",", ")")):
                if colon + 1 < j:
                    self.simple(colon + 1, j)
                return 0, [], False
        self.simple(i, j)
        return 0, [], False

    def define(self, i: int, j: int) -> Tag | None:
        s, name = self.s, self.s.text(i + 1)
        if s.text(i) == "class":
            return self.tag(name, "c", i + 1)
        extra = []
        k = s.find(i + 2, j, {"(", ":"})
        if s.text(k) == "(":
            close = s.close[k]
            if self.opt.on("signature"):
                extra.append(("signature", s.span(k, close)))
            if s.text(close + 1) == "->":
                colon = s.find(close + 2, j, {":"})
                if colon > close + 2:
                    extra.append(("typeref", "typename:" + s.span(close + 2, colon - 1)))
        kind = "m" if self.scopes and self.scopes[-1][0] == "class" else "f"
        return self.tag(name, kind, i + 1, extra)

    def simple(self, i: int, j: int) -> None:
        while i < j:
            end = self.s.find(i, j, SEMICOLON)
            if end > i:
                self.one(i, end)
            i = end + 1

    def one(self, i: int, j: int) -> None:
        s = self.s
        if s.text(i) in ("def", "class"):
            if s.kind(i + 1) == "id":
                self.statement(i, j)
            return
        if s.text(i) in BLOCKS and s.text(i + 1) not in ("=", ",", ":") and s.find(i, j, {":"}) < j:
            self.simple(s.find(i, j, {":"}) + 1, j)
            return
        if s.text(i) == "from":
            self.imports(i, j)
            return
        equal = s.find(i, j, EQUAL)
        colon = s.find(i, equal, COLON)
        if s.text(i) == "lambda" or (equal == j and colon == j):
            return
        left_end = min(colon, equal)
        extra = []
        if colon < equal and colon + 1 < equal:
            extra.append(("typeref", "typename:" + s.span(colon + 1, equal - 1)))
        elif colon < equal:
            return
        local = any(k == "function" for k, _ in self.scopes)
        for a, b in s.parts(i, left_end):
            if s.text(a) in ("(", "[") and s.close[a] == b - 1:
                continue
            if b - a == 1 and s.kind(a) == "id":
                self.tag(s.text(a), "l" if local else "v", i, extra, s.end_row(j - 1))
                if s.text(equal + 1) == "lambda" and equal < j:
                    self.lambdas(a, i, equal + 1, j)
        if equal < j:  # a = b = c
            rest = s.find(equal + 1, j, {"="})
            if rest < j:
                self.one(equal + 1, j)

    def lambdas(self, a: int, i: int, k: int, j: int) -> None:
        """A name for a lambda is a function; a tag of its name made just before gives way."""
        if self.tags and self.tags[-1].name == self.s.text(a):
            self.tags.pop()
        colon = self.s.find(k, j, {":"})
        params = self.s.span(k + 1, colon - 1) if colon > k + 1 else ""
        kind = "m" if any(x == "class" for x, _ in self.scopes) else "f"
        self.tag(self.s.text(a), kind, i, [("signature", f"({params})")], self.s.end_row(j - 1))

    def imports(self, i: int, j: int) -> None:
        s = self.s
        at = s.find(i, j, {"import"})
        module = re.sub(r"\s+", "", s.span(i + 1, at - 1)) if at > i + 1 else ""
        a, b = at + 1, j
        if s.text(a) == "(":
            a, b = a + 1, s.close[a]
        for p, q in s.parts(a, b):
            names = [k for k in range(p, q) if s.kind(k) != "nl"]
            if len(names) >= 3 and s.text(names[-2]) == "as":
                name, alias = s.span(names[0], names[-3]), names[-1]
                where = f"unknown:{name}" if module in ("", ".") else f"module:{module}.{name}"
                self.tag(s.text(alias), "Y", i, [("nameref", where)], s.end_row(j - 1))


def extract(src: Source, opt: Options) -> list[Tag]:
    return _Walk(src, opt).run()
