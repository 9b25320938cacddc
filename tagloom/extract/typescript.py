"""TypeScript: JavaScript's shapes with interfaces, enums, modules, aliases and parameter properties."""

from __future__ import annotations

from .base import Fields, Options, Source, Tag
from .js import Walk

ACCESS = {"public", "private", "protected"}


class _Walk(Walk):
    members = False

    def tag(self, name: str, kind: str, i: int, last: int, extra: list[tuple[str, str]] = ()) -> None:
        if not name or kind not in self.opt.kinds:
            return
        o, f, row = self.opt, Fields(), self.s.row(i)
        if o.on("kind"):
            f.put("kind", kind)
        if o.on("line"):
            f.put("line", str(row + 1))
        f.put("roles", "def", o.on("roles"))
        for k, v in extra:
            f.put(k, v, k != "access" or o.on("access"))
        if o.on("scope") and self.scopes:
            f.put(*self.scopes[-1])
        if o.on("end"):
            f.put("end", str(self.s.end_row(last) + 1))
        self.tags.append(Tag(name, row, kind, f.list()))

    def member(self, *_) -> None:
        """Assignments to members define nothing here."""

    def pair(self, *_) -> None:
        """Nor do pairs of objects."""

    def anonymous_function(self, i: int, end: int) -> None:
        self.code(i + 1, end)

    def function(self, i: int, end: int) -> int:
        if self.s.text(i + 1) == "*":  # generators have no enabled kind
            brace = self.s.find(i, end, {"{"})
            self.code(brace + 1, self.s.close[brace] if brace < end else end)
            return self.s.close[brace] + 1 if brace < end else i + 1
        return super().function(i, end)

    def variable(self, name: str, at: int, last: int, function: bool, constant: bool) -> None:
        local = any(k == "function" for k, _ in self.scopes)
        # the letter of constants stands for another kind, so they never show
        self.tag(name, "f" if function else "l" if local else "C" if constant else "v", at, last)

    def klass(self, i: int, end: int) -> int:
        if self.s.text(i - 1) == "abstract" and i:
            brace = self.s.find(i + 1, end, {"{"})
            if brace < end:
                self.class_body(brace + 1, self.s.close[brace])
                return self.s.close[brace] + 1
        return super().klass(i, end)

    def method(self, name: str, words: list[str], start: int, at: int, paren: int, end: int) -> int:
        s = self.s
        k = s.close[paren] + 1
        if s.text(k) == ":":
            k = self.type_end(k + 1, end)
        body = s.text(k) == "{"
        last = s.close[k] if body else k - 1
        access = [("access", w) for w in words if w in ACCESS]
        self.tag(name, "m", start, last, access)
        if name:
            self.scopes.append(("function", name))
        for a, b in s.parts(paren + 1, s.close[paren]):
            if s.text(a) in ACCESS:
                p = a + 1 + (s.text(a + 1) == "readonly")
                self.tag(s.text(p), "p", a, b - 1, [("access", s.text(a))])
        if body:
            self.code(k + 1, last)
        if name:
            self.scopes.pop()
        return last + 1

    def class_field(self, name: str, words: list[str], start: int, last: int, function: bool) -> None:
        self.tag(name, "p", start, last, [("access", w) for w in words if w in ACCESS])

    def declaration(self, i: int, end: int) -> int:
        s, t = self.s, self.s.text(i)
        named = s.kind(i + 1) == "id" and (i == 0 or s.text(i - 1) not in (".", ":"))
        if t == "interface" and named:
            brace = s.find(i + 2, end, {"{"})
            if brace < end:
                self.tag(s.text(i + 1), "i", i, s.close[brace])
                self.inside(("interface", s.text(i + 1)), brace + 1, s.close[brace], self.signatures)
                return s.close[brace] + 1
        elif t == "enum" and named and s.text(i + 2) == "{":
            close = s.close[i + 2]
            self.tag(s.text(i + 1), "g", i, close)
            self.scopes.append(("enum", s.text(i + 1)))
            for a, b in s.parts(i + 3, close):
                self.tag(self.key(a)[0], "e", a, b - 1)
            self.scopes.pop()
            return close + 1
        elif t == "module" and (s.kind(i + 1) in ("id", "str")) and s.find(i + 1, end, {"{", ";", "="}) < end:
            brace = s.find(i + 1, end, {"{", ";", "="})
            if s.text(brace) == "{" and brace <= i + 6:
                name = s.span(i + 1, brace - 1)
                self.tag(name, "n", i, s.close[brace])
                self.inside(("module", name), brace + 1, s.close[brace])
                return s.close[brace] + 1
        elif t == "type" and named and s.text(s.angles(i + 2, end)) == "=":
            k = s.angles(i + 2, end) + 1
            stop = self.alias_end(k, end)
            self.tag(s.text(i + 1), "a", i, stop - 1)
            self.type_literals(k, stop)
            return stop
        elif t == "declare" and s.kind(i + 1) == "id" and s.text(i + 1) in ("const", "let", "var"):
            stop = self.value_end(i + 2, end)
            if s.text(i + 1) != "const":
                return i + 1
            return stop
        return i

    def alias_end(self, i: int, end: int) -> int:
        s, k = self.s, i
        while k < end and s.text(k) != ";":
            if k > i and s.row(k) > s.end_row(k - 1) and s.text(k) not in ("|", "&", "?", ":", ".", "=>") and s.text(k - 1) not in ("|", "&", "=", "?", ":", "=>"):
                return k
            k = s.skip(k)
        return min(k, end)

    def type_literals(self, i: int, end: int) -> None:
        while i < end:
            if self.s.text(i) == "{":
                self.signatures(i + 1, self.s.close[i])
            i = self.s.skip(i)

    def signatures(self, i: int, end: int) -> None:
        """Members of an interface or an object type."""
        s = self.s
        while i < end:
            if s.text(i) in (";", ","):
                i += 1
                continue
            start = i
            while s.text(i) in ("readonly", "get", "set", "+", "-") and s.text(i + 1) not in ("(", ":", "?", ",", ";"):
                i += 1
            name, k = self.key(i)
            k += s.text(k) == "?"
            k = max(k, s.angles(k, end)) if s.text(k) == "<" else k
            method = s.text(k) == "("
            if method:
                k = s.close[k] + 1
            stop = self.type_end(k + 1, end) if s.text(k) == ":" else k
            if name and s.kind(i) in ("id", "str"):
                self.tag(name, "m" if method else "p", start, stop - 1)
            self.type_literals(k, stop)
            i = max(stop, i + 1)


def extract(src: Source, opt: Options) -> list[Tag]:
    return _Walk(src, opt).run()
