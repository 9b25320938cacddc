"""Go: declarations at any depth; the package is the outer scope of all."""

from __future__ import annotations

from .base import Fields, Lexer, Options, Source, Stream, Tag

LEXER = Lexer(
    [
        ("id", r"[^\W\d]\w*"),
        ("skip", r"//[^\r\n]*"),
        ("skip", r"/\*.*?(?:\*/|\Z)"),
        ("str", r"`[^`]*`?|\"(?:\\.|[^\\\"\r\n])*\"?|'(?:\\.|[^\\'\r\n])*'?"),
        ("num", r"\d[\w.]*"),
        ("op", r":=|<-|\.\.\.|&&|\|\||[-+*/%&|^=!<>]=|\+\+|--|<<|>>"),
    ],
    newlines=True,
)
#: What may begin a declaration.
WORDS = {"package", "import", "const", "var", "type", "func", ":="}
ORDER = ("line", "package", "struct", "interface", "typeref", "signature", "access")


class _Walk:
    def __init__(self, src: Source, opt: Options):
        self.s, self.opt, self.tags = Stream(src, LEXER), opt, []
        self.package = ""

    def tag(self, name: str, kind: str, i: int, last: int, at: int | None = None, typeref: str | None = None, signature: str | None = None, own: list[tuple[str, str]] = (), packaged: bool = True) -> None:
        if name in ("", "_") or kind not in self.opt.kinds:
            return
        o, s = self.opt, self.s
        row = s.row(i if at is None else at)
        extras = dict(own)
        if packaged and self.package:
            extras["package"] = self.package
        if typeref:
            extras["typeref"] = "typename:" + typeref
        if signature is not None and o.on("signature"):
            extras["signature"] = signature
        f = Fields()
        if o.on("line"):
            f.put("line", str(row + 1))
        for key in ("package", "struct", "interface"):
            f.put(key, extras.get(key), o.scope)
        f.put("typeref", extras.get("typeref"), o.on("typeref"))
        f.put("signature", extras.get("signature"), o.on("signature"))
        end = s.end_row(last)
        if o.on("end") and end > row:
            f.put("end", str(end + 1))
        if o.scope:  # what no gate let through comes last
            for k, v in extras.items():
                if k not in f.pairs:
                    f.put(k, v)
        self.tags.append(Tag(name, row, kind, f.list()))

    def skip_nl(self, i: int) -> int:
        while self.s.kind(i) == "nl":
            i += 1
        return i

    def line_end(self, i: int, end: int) -> int:
        return self.s.find(i, end, {"\n", ";"})

    def run(self) -> list[Tag]:
        self.walk(0, len(self.s))
        return self.tags

    def walk(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            t = s.text(i)
            if t not in WORDS:
                i += 1
                continue
            first = i == 0 or s.text(i - 1) in ("\n", ";", "{", "}") or s.kind(i - 1) == "nl"
            if t == "package" and first and s.kind(i + 1) == "id":
                self.package = ""
                self.tag(s.text(i + 1), "p", i + 1, i + 1, packaged=False)
                self.package = s.text(i + 1)
                i += 2
            elif t == "import" and first:
                i = self.group(i + 1, end, self.import_spec)
            elif t == "const" and first:
                i = self.group(i + 1, end, lambda a, b: self.values(a, b, "c"))
            elif t == "var" and first:
                i = self.group(i + 1, end, lambda a, b: self.values(a, b, "v"))
            elif t == "type" and first:
                i = self.types(i + 1, end)
            elif t == "func" and first:
                i = self.function(i, end)
            elif t == ":=":
                k = i
                while s.kind(k - 1) == "id" and k - 1 >= 0:
                    k -= 1
                    if s.text(k - 1) == ",":
                        k -= 1
                    else:
                        break
                last = self.line_end(i, end)
                for a in range(k, i):
                    if s.kind(a) == "id":
                        self.tag(s.text(a), "v", a, last - 1)
                i += 1
            else:
                i += 1

    def group(self, i: int, end: int, spec) -> int:
        """One declaration, or those in parentheses; their values are walked for what they define."""
        s = self.s
        if s.text(i) == "(":
            k, stop = i + 1, s.close[i]
            while k < stop:
                k = self.skip_nl(k)
                b = min(self.line_end(k, stop), stop)
                if k < b:
                    spec(k, b)
                k = b + 1
            return stop + 1
        b = self.line_end(i, end)
        spec(i, b)
        return b

    def import_spec(self, a: int, b: int) -> None:
        s = self.s
        if s.kind(a) == "id" and s.kind(a + 1) == "str":
            path = s.text(a + 1).strip('"`')
            self.tag(s.text(a), "P", a, b - 1, own=[("package", path)], packaged=False)

    def values(self, a: int, b: int, kind: str) -> None:
        s, names = self.s, []
        k = a
        while s.kind(k) == "id" and k < b:
            names.append(k)
            if s.text(k + 1) != ",":
                k += 1
                break
            k = self.skip_nl(k + 2)
        equal = s.find(k, b, {"="})
        typeref = s.span(k, equal - 1) if equal > k else None
        for n in names:
            self.tag(s.text(n), kind, n, b - 1, typeref=typeref)
        self.walk(min(equal + 1, b), b)

    def types(self, i: int, end: int) -> int:
        """Types first, then the methods of all interfaces among them, as the last type's: none if that is no interface."""
        self.methods, self.owner = [], None
        after = self.group(i, end, self.type_spec)
        for a, b in self.methods if self.owner else ():
            self.method_spec(a, b, self.owner)
        return after

    def type_spec(self, a: int, b: int) -> None:
        s, name = self.s, self.s.text(a)
        if s.kind(a) != "id":
            return
        k = a + 1
        if s.text(k) == "[" and s.kind(k + 1) == "id" and s.close[k] > k + 2:  # type parameters
            k = s.close[k] + 1
        alias = s.text(k) == "="
        k += alias
        full = f"{self.package}.{name}" if self.package else name
        if s.text(k) in ("struct", "interface") and s.text(k + 1) == "{":
            what, close = s.text(k), s.close[k + 1]
            if not alias:
                self.owner = full if what == "interface" else None
            self.tag(name, "s" if what == "struct" else "i", a, close, at=k)
            i = k + 2
            while i < close:
                i = self.skip_nl(i)
                e = min(self.line_end(i, close), close)
                if i < e and what == "struct":
                    self.struct_field(i, e, full)
                elif i < e:
                    self.methods.append((i, e))
                i = e + 1
        elif k < b:
            self.owner = self.owner if alias else None
            self.tag(name, "t", a, b - 1, at=k, typeref=s.span(k, b - 1))

    def struct_field(self, a: int, b: int, owner: str) -> None:
        s, names, k = self.s, [], a
        while s.kind(k) == "id" and k < b:
            names.append(k)
            if s.text(k + 1) != ",":
                k += 1
                break
            k = self.skip_nl(k + 2)
        last = b - 1 if s.kind(b - 1) != "str" else b - 2
        if k <= last and s.text(k) != ".":
            for n in names:
                self.tag(s.text(n), "m", n, b - 1, at=a, typeref=s.span(k, last), own=[("struct", owner)], packaged=False)

    def method_spec(self, a: int, b: int, owner: str) -> None:
        s = self.s
        if s.kind(a) == "id" and s.text(a + 1) == "(":
            k = s.close[a + 1] + 1
            self.tag(s.text(a), "n", a, b - 1, typeref=s.span(k, b - 1) if k < b else None, own=[("interface", owner)], packaged=False)

    def function(self, i: int, end: int) -> int:
        s, k, own = self.s, i + 1, None
        if s.text(k) == "(":
            inner = [x for x in range(k + 1, s.close[k]) if s.kind(x) != "nl"]
            stop = next((x for x in inner if s.text(x) == "["), s.close[k])
            names = [x for x in inner if x < stop and s.kind(x) == "id"]
            own = s.text(names[-1]) if names else None
            k = s.close[k] + 1
        if s.kind(k) != "id":
            return i + 1
        name, at = s.text(k), k
        k += 1
        if s.text(k) == "[":
            k = s.close[k] + 1
        if s.text(k) != "(":
            return k
        signature, after = s.span(k, s.close[k]), s.close[k] + 1
        body = self.body_of(after, end)
        last = s.close[body] if body >= 0 else self.line_end(after, end) - 1
        stop = body if body >= 0 else self.line_end(after, end)
        typeref = s.span(after, stop - 1) if stop > after else None
        full = f"{self.package}.{own}" if self.package else own
        self.tag(name, "f", at, last, typeref=typeref, signature=signature, own=[("struct", full)] if own else [], packaged=own is None)
        if body >= 0:
            self.walk(body + 1, last)
        return last + 1

    def body_of(self, i: int, end: int) -> int:
        """The ``{`` of a function's body; those of struct and interface types in its result are not."""
        while i < end and self.s.kind(i) != "nl":
            if self.s.text(i) == "{":
                if self.s.text(i - 1) not in ("struct", "interface"):
                    return i
            i = self.s.skip(i)
        return -1


def extract(src: Source, opt: Options) -> list[Tag]:
    return _Walk(src, opt).run()
