"""Rust: items by keyword, with modules, traits, impls and types as scopes."""

from __future__ import annotations

from .base import Fields, Lexer, Options, Source, Stream, Tag, squeeze

LEXER = Lexer(
    [
        # a name that cannot begin a string
        ("id", r"[^\W\dbcr]\w*"),
        ("skip", r"//[^\r\n]*"),
        ("skip", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/)?"),
        ("str", r"(?:b|c)?r\#+\".*?\"\#+|(?:b|c)?r?\"(?:\\.|[^\\\"])*\"?"),
        ("str", r"b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\r\n])'"),
        ("life", r"'[A-Za-z_]\w*"),
        ("id", r"r\#[A-Za-z_]\w*|[^\W\d]\w*"),
        ("num", r"\d[\w.]*"),
        ("op", r"::|->|=>|\.\.=|\.\.\.|\.\."),
    ]
)
KEYS = {"struct": "struct", "enum": "enum", "union": "union", "trait": "interface", "impl": "implementation"}
#: Words that may begin an item, as may a name before !.
ITEMS = {"#", "macro_rules", "mod", "struct", "enum", "trait", "union", "impl", "fn", "const", "static", "type"}
BEFORE_ITEM = {"", "}", ";", "{", "]", "unsafe", "default", "pub", ")", "const", "async"}


class _Walk:
    def __init__(self, src: Source, opt: Options):
        self.s, self.opt, self.tags = Stream(src, LEXER), opt, []
        self.scopes: list[tuple[str, str]] = []

    def tag(self, name: str, kind: str, i: int, end: int, extra: list[tuple[str, str]] = (), signature: str | None = None, row: int | None = None) -> None:
        if name in ("", "_") or kind not in self.opt.kinds:
            return
        o, f = self.opt, Fields()
        row = self.s.row(i) if row is None else row
        if o.on("kind"):
            f.put("kind", kind)
        if o.on("line"):
            f.put("line", str(row + 1))
        f.put("file", o.file_name, o.on("file"))
        f.put("signature", signature, o.on("signature"))
        if o.scope:
            for k, n in self.scopes:
                if k != "module":
                    f.put(KEYS[k], n)
            modules = [n for k, n in self.scopes if k == "module"]
            f.put("module", "::".join(modules) if modules else None)
        if o.on("end"):
            f.put("end", str(self.s.end_row(end) + 1))
        for k, v in extra:
            f.put(k, v, o.scope)
        self.tags.append(Tag(name, row, kind, f.list()))

    def run(self) -> list[Tag]:
        self.items(0, len(self.s))
        return self.tags

    def body(self, i: int, end: int, scope: tuple[str, str] | None) -> None:
        if scope and scope[1]:
            self.scopes.append(scope)
        self.items(i, end)
        if scope and scope[1]:
            self.scopes.pop()

    def item_end(self, i: int, end: int) -> tuple[int, int]:
        """The item's last token, and its body's ``{`` or -1."""
        k = i
        while k < end:
            t = self.s.text(k)
            if t == ";":
                return k, -1
            if t == "{":
                return self.s.close[k], k
            k = self.s.skip(k)
        return end - 1, -1

    def items(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            t, nxt = s.text(i), s.text(i + 1)
            if t not in ITEMS and nxt != "!":
                i += 1
                continue
            named = s.kind(i) == "id" and s.kind(i + 1) == "id"
            before = s.text(i - 1) if i else ""
            if t == "#" and nxt in ("[", "!"):
                i = s.skip(i + (nxt == "!") + 1)
            elif t == "macro_rules" and nxt == "!":
                k = s.skip(i + 3)
                self.tag(s.text(i + 2), "M", i + 2, k - 1, row=s.row(i + 2))
                i = k
            elif s.kind(i) == "id" and nxt == "!" and s.text(i + 2) in ("(", "[", "{"):
                self.macro(i + 3, s.close[i + 2])
                i = s.skip(i + 2)
            elif t == "mod" and named:
                last, brace = self.item_end(i + 2, end)
                self.tag(nxt, "n", i + 1, last)
                if brace >= 0:
                    self.body(brace + 1, last, ("module", nxt))
                i = last + 1
            elif t in ("struct", "enum", "trait") and named or t == "union" and named and s.text(i + 2) in ("{", "<"):
                i = self.type_item(t, i, end)
            elif t == "impl" and before in BEFORE_ITEM:
                i = self.impl(i, end)
            elif t == "fn" and named:
                i = self.function(i, end)
            elif t in ("const", "static") and before not in ("*", "<", ",", "&", "(", "|"):
                k = i + 1 + (s.text(i + 1) == "mut")
                if s.kind(k) == "id" and s.text(k + 1) == ":" and s.text(k) not in ("fn", "unsafe", "async", "extern"):
                    last = s.find(k, end, {";"})
                    self.tag(s.text(k), "C" if t == "const" else "v", k, last)
                    self.items(k + 1, min(last, end))
                    i = last
                i += 1
            elif t == "type" and named:
                last = s.find(i, end, {";"})
                associated = bool(self.scopes) and self.scopes[-1][0] == "trait" and s.find(i, last, {"="}) == last
                self.tag(nxt, "T" if associated else "t", i + 1, last)
                i = last + 1
            else:
                i += 1

    def type_item(self, t: str, i: int, end: int) -> int:
        s, name = self.s, self.s.text(i + 1)
        last, brace = self.item_end(i + 2, end)
        self.tag(name, {"struct": "s", "enum": "g", "trait": "i", "union": "u"}[t], i + 1, last)
        if brace >= 0 and t in ("struct", "enum"):
            for a, b in s.parts(brace + 1, last):
                while s.text(a) == "#":
                    a = s.skip(a + 1)
                if s.text(a) == "pub":
                    a = s.skip(a + 1) if s.text(a + 1) == "(" else a + 1
                if a < b and s.kind(a) == "id" and (t == "enum" or s.text(a + 1) == ":"):
                    self.tag(s.text(a), "m" if t == "struct" else "e", a, b - 1, [(t, name)] if self.opt.scope else [])
        elif brace >= 0 and t == "trait":
            self.body(brace + 1, last, ("trait", name))
        return last + 1

    def impl(self, i: int, end: int) -> int:
        s = self.s
        last, brace = self.item_end(i + 1, end)
        if brace < 0:
            return i + 1
        k = s.angles(i + 1, brace)
        stop = s.find(k, brace, {"where"})
        at, depth, split = k, 0, None
        while at < stop:
            text = s.text(at)
            depth += (text == "<") - (text == ">")
            if text == "for" and depth == 0 and s.text(at + 1) != "<":
                split = at
            at = s.skip(at)
        target = split + 1 if split is not None else k
        trait = s.span(k, split - 1).lstrip("!") if split is not None else None
        name = s.span(target, stop - 1)
        if s.kind(target) == "id":
            self.tag(name, "c", target, last, [("trait", trait)] if trait and self.opt.scope else [])
            self.body(brace + 1, last, ("impl", name))
        else:
            self.items(brace + 1, last)
        return last + 1

    def function(self, i: int, end: int) -> int:
        s = self.s
        last, brace = self.item_end(i + 2, end)
        paren = s.find(i + 2, last, {"("})
        signature = None
        if s.text(paren) == "(":
            signature = s.span(paren, s.close[paren])
            arrow = s.close[paren] + 1
            if s.text(arrow) == "->":
                stop = s.find(arrow, brace if brace >= 0 else last, {"where"})
                signature += " -> " + s.span(arrow + 1, stop - 1)
            signature = squeeze(signature)
        owned = bool(self.scopes) and self.scopes[-1][0] != "module"
        self.tag(s.text(i + 1), ("P" if owned else "f") if brace >= 0 else "m", i + 1, last, signature=signature)
        if brace >= 0:
            self.items(brace + 1, last)
        return last + 1

    def macro(self, i: int, end: int) -> None:
        """Types that a macro call's tokens seem to define."""
        for k in range(i, end - 1):
            kind = {"struct": "s", "enum": "g", "union": "u"}.get(self.s.text(k))
            if kind and self.s.kind(k + 1) == "id":
                self.tag(self.s.text(k + 1), kind, k + 1, k + 1)


def extract(src: Source, opt: Options) -> list[Tag]:
    return _Walk(src, opt).run()
