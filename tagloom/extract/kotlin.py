"""Kotlin: declarations at any depth, lambdas included, with dotted scope paths under the package."""

from __future__ import annotations

from .base import Lexer, Options, Source, Stream, Tag

LEXER = Lexer(
    [
        ("id", r"`[^`\r\n]+`|[^\W\d]\w*"),
        ("skip", r"//[^\r\n]*"),
        ("skip", r"/\*.*?(?:\*/|\Z)"),
        ("str", r"\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|\$\{[^{}]*\}|[^\\\"\r\n])*\"?|'(?:\\.|[^\\'\r\n])*'?"),
        ("num", r"\d[\w.]*"),
        ("op", r"->|::|\?:|\?\.|\.\.|!!|[-+*/%=!<>]=|&&|\|\|"),
    ],
    newlines=True,
)


#: What may begin a declaration or a lambda.
WORDS = {"package", "import", "class", "interface", "object", "fun", "val", "var", "typealias", "for", "{"}


class _Walk:
    def __init__(self, src: Source, opt: Options):
        self.s, self.opt, self.tags = Stream(src, LEXER), opt, []
        self.scopes: list[tuple[str, str]] = []

    def tag(self, name: str, kind: str, i: int, last: int, scoped: bool = True) -> None:
        if kind not in self.opt.kinds or name in ("", "_"):
            return
        fields = []
        if self.opt.on("end") and self.s.end_row(last) > self.s.row(i):
            fields.append(("end", str(self.s.end_row(last) + 1)))
        if scoped and self.scopes and self.opt.scope:
            fields.append((self.scopes[-1][0], ".".join(n for _, n in self.scopes)))
        self.tags.append(Tag(name, self.s.row(i), kind, fields))

    def run(self) -> list[Tag]:
        self.walk(0, len(self.s))
        return self.tags

    def nl(self, i: int) -> int:
        while self.s.kind(i) == "nl":
            i += 1
        return i

    def expression_end(self, i: int, end: int) -> int:
        """After the expression at i: a new line that no operator spans, or what closes it."""
        s, k = self.s, self.nl(i)
        while k < end:
            t = s.text(k)
            if t in (";", ",", ")", "]", "}"):
                return k
            if s.kind(k) == "nl":
                n = self.nl(k)
                joins = s.text(k - 1) in ("=", "+", "-", "*", "/", "&&", "||", "?:", "->", ",", ".", "else") or s.text(n) in (".", "?.", "?:", "&&", "||", "else")
                if not joins:
                    return k
                k = n
                continue
            k = s.skip(k)
        return min(k, end)

    def inside(self, scope: tuple[str, str], i: int, end: int) -> None:
        self.scopes.append(scope)
        self.walk(i, end)
        self.scopes.pop()

    def walk(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            t = s.text(i)
            if t not in WORDS:
                i += 1
                continue
            nxt, before = s.text(i + 1), s.text(i - 1) if i else ""
            named = s.kind(i + 1) == "id"
            if before in (".", "?.", "::"):
                i += 1
            elif t == "package" and named and not self.scopes:
                stop = s.find(i, end, {"\n", ";"})
                name = s.span(i + 1, stop - 1)
                self.tag(name, "p", i + 1, stop - 1, scoped=False)
                self.scopes.append(("package", name))
                i = stop
            elif t == "import" and named:
                i = s.find(i, end, {"\n", ";"})
            elif t in ("class", "interface") and named:
                i = self.klass(i, end)
            elif t == "object" and (named or nxt in ("{", ":")):
                i = self.object(i, end)
            elif t == "fun" and (named or nxt in ("<", "(")):
                i = self.function(i, end)
            elif t in ("val", "var") and (named or nxt in ("(", "<")):
                i = self.property(i, end)
            elif t == "typealias" and named:
                stop = self.expression_end(i, end)
                self.tag(nxt, "T", i + 1, stop - 1)
                i = stop
            elif t == "for" and nxt == "(":
                k = i + 2
                names = self.bindings(k)
                for a in names:
                    self.tag(s.text(a), "C" if s.text(k) == "(" else "m", a, a)
                self.walk(s.find(k, s.close[i + 1], {"in"}), s.close[i + 1])
                i = s.close[i + 1] + 1
            elif t == "{" and self.is_lambda(i):
                self.lambda_(i)
                i = s.close[i] + 1
            else:
                i += 1

    def bindings(self, k: int) -> list[int]:
        s = self.s
        if s.text(k) == "(":
            return [a for a, _ in s.parts(k + 1, s.close[k]) if s.kind(a) == "id"]
        return [k] if s.kind(k) == "id" else []

    BLOCK_WORDS = {"else", "try", "finally", "do", "init", "get", "set"}

    def is_lambda(self, i: int) -> bool:
        """A brace that no declaration or control statement owns."""
        s = self.s
        k = i - 1
        while s.kind(k) == "nl":
            k -= 1
        if k < 0 or s.text(k) in self.BLOCK_WORDS or s.text(k) in ("->",) and not self.in_call(i):
            return False
        if s.text(k) == ")":
            o = next((j for j in range(k, -1, -1) if s.close[j] == k), -1)
            if s.text(o - 1) in ("if", "while", "when", "catch", "for", "constructor", "get", "set"):
                return False
            return True
        return not (s.text(k) == "when" or s.kind(i - 1) == "nl" and s.text(k) in ("{", "}", ";"))

    def in_call(self, i: int) -> bool:
        return False

    def lambda_(self, i: int, name: str | None = None) -> None:
        s, close = self.s, self.s.close[i]
        if name is None:
            self.tag("<lambda>", "m", i, close)
        arrow = s.find(i + 1, close, {"->"})
        start = i + 1
        self.scopes.append(("method", name or "<lambda>"))
        if arrow < close and not any(s.text(k) in ("when", "=", ";") or s.kind(k) == "nl" and k > self.nl(i + 1) for k in range(self.nl(i + 1), arrow)):
            for a, _ in s.parts(i + 1, arrow):
                for b in self.bindings(self.nl(a)):
                    self.tag(s.text(b), "m", b, b)
            start = arrow + 1
        self.walk(start, close)
        self.scopes.pop()

    def klass(self, i: int, end: int) -> int:
        s, key, name = self.s, self.s.text(i), self.s.text(i + 1)
        k = i + 2
        if s.text(k) == "<":
            k = max(s.angles(k, end), k)
        while s.text(k) in ("private", "protected", "internal", "public", "constructor", "@"):
            k += 1
        params = k if s.text(k) == "(" else -1
        if params >= 0:
            k = s.close[k] + 1
        brace = -1
        j = k
        if s.text(self.nl(j)) == ":" or s.text(j) == ":":
            j = self.nl(j) + 1
            while j < end and s.text(j) != "{" and not (s.kind(j) == "nl" and s.text(j - 1) != "," and s.text(self.nl(j)) != "{"):
                j = s.skip(j)
        if s.text(self.nl(j)) == "{":
            brace = self.nl(j)
        last = s.close[brace] if brace >= 0 else (s.close[params] if params >= 0 else i + 1)
        self.tag(name, "i" if key == "interface" else "c", i + 1, last)
        self.scopes.append((key, name))
        if params >= 0:
            for a, b in s.parts(params + 1, s.close[params]):
                for q in range(a, b):
                    if s.text(q) in ("val", "var") and s.kind(q + 1) == "id":
                        self.tag(s.text(q + 1), "C" if s.text(q) == "val" else "v", q + 1, b - 1)
                        break
                equal = s.find(a, b, {"="})
                self.walk(equal, b)
        if brace >= 0:
            self.walk(brace + 1, last)
        self.scopes.pop()
        return last + 1

    def object(self, i: int, end: int) -> int:
        s = self.s
        name = s.text(i + 1) if s.kind(i + 1) == "id" else ""
        brace = i + 1 + bool(name)
        while brace < end and s.text(brace) != "{" and s.kind(brace) != "nl":
            brace = s.skip(brace)
        body = s.text(brace) == "{"
        last = s.close[brace] if body else brace - 1
        self.tag(name, "o", i + 1, last)
        if body:
            if name:
                self.inside(("object", name), brace + 1, last)
            else:
                self.walk(brace + 1, last)
        return last + 1

    def function(self, i: int, end: int) -> int:
        s, k = self.s, i + 1
        if s.text(k) == "<":
            k = max(s.angles(k, end), k + 1)
        paren = s.find(k, end, {"(", "\n"})
        if s.text(paren) != "(":
            return i + 1
        name = paren - 1 if s.kind(paren - 1) == "id" and paren - 1 >= k else -1
        stop, j = end, s.close[paren] + 1
        if s.text(j) == ":":
            j += 1
            while j < end and s.text(j) not in ("{", "=") and s.kind(j) != "nl":
                j = s.skip(j)
        body = self.nl(j)
        if s.text(j) == "=" or s.text(body) == "=":
            stop = self.expression_end(self.nl(j) + 1, end)
            start = self.nl(j) + 1
        elif s.text(body) == "{":
            start, stop = body + 1, s.close[body]
        else:
            start = stop = j
        last = stop if s.text(body) == "{" else max(stop - 1, paren)
        if name >= 0:
            self.tag(s.text(name), "m", name, min(last, len(s) - 1))
        for a, b in s.parts(paren + 1, s.close[paren]):
            equal = s.find(a, b, {"="})
            self.walk(equal, b)
        self.scopes.append(("method", s.text(name))) if name >= 0 else None
        if s.text(start) == "{" and s.text(body) == "=":
            self.lambda_(start)
        else:
            self.walk(start, stop)
        if name >= 0:
            self.scopes.pop()
        return max(stop, i + 1)

    def property(self, i: int, end: int) -> int:
        s, kind = self.s, "C" if self.s.text(i) == "val" else "v"
        k = i + 1
        if s.text(k) == "<":
            k = max(s.angles(k, end), k + 1)
        names = self.bindings(k)
        after = s.skip(k)
        while s.text(after) == "." and s.kind(after + 1) == "id":  # an extension property's name is last
            names, after = [after + 1], after + 2
        if s.text(after) == ":":
            after += 1
            while after < end and s.text(after) not in ("=", "{", "by", ",", ")") and s.kind(after) != "nl":
                after = max(s.angles(after, end), s.skip(after)) if s.text(after) == "<" else s.skip(after)
        value = self.nl(after) if s.text(self.nl(after)) == "=" else after
        stop = self.expression_end(value + 1, end) if s.text(value) in ("=", "by") else after
        for a in names:
            self.tag(s.text(a), kind, a, max(stop - 1, a))
        if s.text(value) in ("=", "by"):
            start = self.nl(value + 1)
            if s.text(start) == "{" and len(names) == 1 and s.close[start] + 1 >= stop:
                self.lambda_(start, s.text(names[0]))
            else:
                self.walk(start, stop)
        return max(stop, k + 1)


def extract(src: Source, opt: Options) -> list[Tag]:
    return _Walk(src, opt).run()
