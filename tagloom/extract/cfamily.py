"""C and C++: declarations by their specifiers and declarators."""

from __future__ import annotations

import re

from .base import Fields, Lexer, Options, Source, Stream, Tag, djb2

LEXER = Lexer(
    [
        # a name that cannot begin a string
        ("id", r"[^\W\duULR]\w*"),
        ("skip", r"//[^\r\n]*"),
        ("skip", r"/\*.*?(?:\*/|\Z)"),
        ("pre", r"\#(?:[^\\\r\n/]|\\(?:\r\n|\r|\n)|\\.|/(?![/*])|/\*.*?\*/)*"),
        ("str", r"(?:u8|[uUL])?R\"\((?:.*?)\)\"|(?:u8|[uUL])?\"(?:\\.|[^\\\"\r\n])*\"?|(?:u8|[uUL])?'(?:\\.|[^\\'\r\n])*'"),
        ("id", r"[^\W\d]\w*"),
        ("num", r"\.?\d(?:[eEpP][+-]|'\w|[\w.])*"),
        ("op", r"::|->\*?|\.\.\.|<<=|>>=|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|<<"),
    ]
)
# Words of the languages that are not names of types or variables.
SIZED = {"unsigned", "signed", "long", "short"}
PRIMITIVE = {"void", "int", "char", "float", "double", "bool", "size_t", "ssize_t", "ptrdiff_t", "intptr_t", "uintptr_t", "charptr_t", "nullptr_t", "max_align_t", *(f"{u}int{n}_t" for u in ("", "u") for n in (8, 16, 32, 64)), *(f"char{n}_t" for n in (8, 16, 32))}
QUALIFIERS = {"const", "volatile", "restrict", "constexpr", "consteval", "constinit", "inline", "static", "extern", "register", "thread_local", "mutable", "virtual", "explicit", "friend", "typename", "_Noreturn", "noreturn", "__inline", "__restrict", "__extension__", "_Atomic", "final", "override", "noexcept"}
STATEMENTS = {"return", "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "goto", "try", "catch", "throw", "new", "delete", "sizeof", "co_return", "co_await", "co_yield", "static_assert", "this", "asm"}
TYPE_WORDS = {"struct": "struct", "class": "class", "union": "union"}


class _Walk:
    def __init__(self, src: Source, opt: Options, lang: str):
        self.s, self.opt, self.tags, self.cpp = Stream(src, LEXER), opt, [], lang == "c++"
        self.scopes: list[tuple[str, str]] = []
        self.anonymous = 0

    def tag(self, name: str, kind: str, i: int, last: int | None = None, extra: list[tuple[str, str]] = ()) -> None:
        if name in ("", "_") or kind not in self.opt.kinds:
            return
        o, f, row = self.opt, Fields(), self.s.row(i)
        if o.on("kind"):
            f.put("kind", kind)
        if o.on("line"):
            f.put("line", str(row + 1))
        f.put("file", "", o.file_scope)
        if o.scope:
            for k, n in self.scopes:
                if k != "namespace":
                    f.put(k, n)
            spaces = [n for k, n in self.scopes if k == "namespace"]
            f.put("namespace", "::".join(spaces) if spaces else None)
        extras = dict(extra)
        f.put("typeref", extras.pop("typeref", None))
        if o.on("end"):
            f.put("end", str(self.s.end_row(i if last is None else last) + 1))
        for k, v in extras.items():
            f.put(k, v, o.scope)
        self.tags.append(Tag(name, row, kind, f.list()))

    def run(self) -> list[Tag]:
        self.walk(0, len(self.s), "top")
        return self.tags

    def local(self) -> bool:
        return any(k == "function" for k, _ in self.scopes)

    def inside(self, scope: tuple[str, str] | None, i: int, end: int, how: str) -> None:
        if scope and scope[1]:
            self.scopes.append(scope)
        self.walk(i, end, how)
        if scope and scope[1]:
            self.scopes.pop()

    # preprocessor
    def directive(self, i: int) -> None:
        text = self.s.text(i)
        m = re.match(r"#\s*define\s+([^\W\d]\w*)(\(([^()]*)\))?", text)
        if m:
            self.tag(m[1], "d", i)
            if m[2] is not None:
                for p in re.findall(r"[^\W\d]\w*", m[3]):
                    self.tag(p, "D", i, extra=[("macro", m[1])])
            return
        m = re.match(r"#\s*include\s*([<\"][^>\"]*[>\"])", text)
        if m:
            self.tag(m[1].strip('<>"'), "h", i)

    # statements
    def walk(self, i: int, end: int, how: str) -> None:
        """how: top (or namespace), fields (of a type), code (of a function)."""
        s = self.s
        while i < end:
            t, nxt = s.text(i), s.text(i + 1)
            if s.kind(i) == "pre":
                self.directive(i)
                i += 1
            elif t in (";", "}", ",", ")") or s.kind(i) in ("str", "num"):
                i += 1
            elif t == "{":
                self.walk(i + 1, s.close[i], how)
                i = s.close[i] + 1
            elif t == "[" and nxt == "[":
                i = s.close[i] + 1
            elif t == "extern" and s.kind(i + 1) == "str":
                if s.text(i + 2) == "{":
                    self.walk(i + 3, s.close[i + 2], how)
                    i = s.close[i + 2] + 1
                else:
                    i += 2
            elif self.cpp and t in ("namespace", "using", "template") or t == "inline" and nxt == "namespace":
                i = self.special(i + (t == "inline"), end, how)
            elif t in ("public", "private", "protected") and nxt == ":":
                i += 2
            elif t in ("case", "default"):
                i = min(s.find(i, end, {":", ";"}) + 1, end)
            elif how == "code" and s.kind(i) == "id" and nxt == ":" and s.text(i + 2) != ":":
                self.tag(t, "L", i)
                i += 2
            elif t in STATEMENTS:
                i = self.control(i, end, how)
            elif t == "typedef":
                i = self.typedef(i, end)
            elif t == "friend":
                i = min(s.find(i, end, {";", "{"}) + 1, end)
            else:
                i = self.declaration(i, end, how)

    def control(self, i: int, end: int, how: str) -> int:
        s = self.s
        if s.text(i) in ("for", "if", "while", "switch", "catch") and s.text(i + 1) == "(":
            close = s.close[i + 1]
            if s.text(i) == "for":
                self.walk(i + 2, close, "code")
            return close + 1
        if s.text(i) in ("else", "do", "try"):
            return i + 1
        stop = s.find(i, end, {";", "{"})
        return stop + 1 if s.text(stop) == ";" else max(stop, i + 1)

    def special(self, i: int, end: int, how: str) -> int:
        s, t = self.s, self.s.text(i)
        if t == "namespace":
            stop = s.find(i + 1, end, {"{", ";", "="})
            name = s.span(i + 1, stop - 1) if stop > i + 1 else ""
            if s.text(stop) == "=":
                self.tag(name, "A", i, stop)
                return s.find(stop, end, {";"}) + 1
            if s.text(stop) != "{":
                return stop + 1
            self.tag(name, "n", i, s.close[stop])
            self.inside(("namespace", name) if name else None, stop + 1, s.close[stop], "top")
            return s.close[stop] + 1
        if t == "using":
            stop = s.find(i, end, {";"})
            equal = s.find(i, stop, {"="})
            if equal == stop:
                k = i + 1 + (s.text(i + 1) in ("namespace", "typename"))
                self.tag(s.span(k, stop - 1), "U", i, stop)
            return stop + 1
        if s.text(i + 1) != "<":  # explicit instantiation
            return i + 1
        k = s.angles(i + 1, end)
        if k > i + 1:
            for a, b in s.parts(i + 2, k - 1):
                if s.text(a) in ("class", "typename") and s.kind(b - 1) == "id" and b - a > 1:
                    at = s.find(a, b, {"="}) - 1
                    if s.kind(at) == "id" and at > a:
                        self.tag(s.text(at), "Z", at)
        return max(k, i + 1)

    # types
    def type_body(self, i: int, end: int) -> tuple[int, str | None, str, bool]:
        """A struct, class, union or enum specifier at i: the index after it, its typeref, name, and whether it has a body."""
        s, word = self.s, self.s.text(i)
        k = i + 1
        if word == "enum":
            return self.enum(i, end)
        while s.text(k) == "[" or s.text(k) in ("__attribute__", "alignas"):
            k = s.skip(k) if s.text(k) == "[" else s.skip(k + 1)
        name = ""
        if s.kind(k) == "id" and s.text(k) not in QUALIFIERS:
            while s.kind(k + 1) == "id" and s.text(k + 1) not in QUALIFIERS and s.text(k + 2) in ("{", ":"):
                k += 1  # an export macro before the name
            name = s.text(k)
            k += 1
            if s.text(k) == "<":
                k = max(s.angles(k, end), k)
        brace = -1
        j = k + (s.text(k) == "final")
        if s.text(j) == "{":
            brace = j
        elif s.text(j) == ":" and s.text(j + 1) != ":":
            j = s.find(j, end, {"{", ";"})
            brace = j if s.text(j) == "{" else -1
        last = s.close[brace] if brace >= 0 else max(k - 1, i)
        kind = {"struct": "s", "class": "c", "union": "u"}[word]
        scope = (TYPE_WORDS[word], name)
        if word == "struct" and self.local():
            scope = None
        elif name:
            if word == "struct" or brace >= 0:
                self.tag(name, kind, i, last)
        elif word == "struct":
            self.anonymous += 1
            name_now = f"__anon{djb2(self.opt.file_name)}{self.anonymous:02x}08"
            self.tag(name_now, "s", i, last)
            scope = ("struct", name_now)
        else:
            scope = None
        if brace >= 0:
            self.inside(scope, brace + 1, last, "fields")
        return last + 1, (f"struct:{name}" if word == "struct" and name else None), name, brace >= 0

    def enum(self, i: int, end: int) -> tuple[int, str | None, str, bool]:
        s = self.s
        k = i + 1 + (s.text(i + 1) in ("class", "struct"))
        name = s.text(k) if s.kind(k) == "id" else ""
        k += bool(name)
        base = None
        brace = s.find(k, end, {"{", ";", ",", ")", "="}) if s.text(k) == ":" else k
        if s.text(k) == ":" and brace > k + 1:
            base = s.span(k + 1, brace - 1)
        if s.text(brace) != "{":
            return k, None, name, False
        close = s.close[brace]
        if name:
            self.tag(name, "g", i, close, [("typeref", f"typename:{base}")] if base else [])
            self.scopes.append(("enum", name))
            for a, b in s.parts(brace + 1, close):
                while s.kind(a) == "pre" and a < b:
                    self.directive(a)
                    a += 1
                if s.kind(a) == "id":
                    self.tag(s.text(a), "e", a, b - 1)
            self.scopes.pop()
        return close + 1, None, name, True

    def specifiers(self, i: int, end: int) -> tuple[int, str | None, bool, bool, bool]:
        """What stands before declarators: index after it, the type, whether it is a bare struct, extern, has a body."""
        s, typ, struct, extern, body, done = self.s, None, False, False, False, False
        sized: list[int] = []
        while i < end:
            t = s.text(i)
            if t in ("struct", "class", "union", "enum"):
                i, struct_type, _, body = self.type_body(i, end)
                typ, struct, done = struct_type or typ, struct_type is not None, True
            elif t in QUALIFIERS or t == "[" and s.text(i + 1) == "[":
                extern = extern or t == "extern"
                i = s.close[i] + 1 if t == "[" else i + 1
            elif t in ("__attribute__", "alignas", "__declspec") and s.text(i + 1) == "(":
                i = s.close[i + 1] + 1
            elif t in SIZED or t in ("int", "char", "double") and sized:
                sized.append(i)
                typ = s.span(sized[0], i)
                i += 1
            elif t in PRIMITIVE or t in ("auto", "decltype") and typ is None:
                typ = typ if sized else t
                i += 1
                if t == "decltype" and s.text(i) == "(":
                    i = s.close[i] + 1
                if t in ("auto", "decltype"):
                    typ = None
                    break
            elif s.kind(i) == "id" and typ is None and not done and t not in STATEMENTS and t != "operator":
                k = self.qualified(i, end)
                # a name that its own parameters follow is no type
                if s.text(k) == "(" and (s.text(k + 1) != "*" or s.kind(k + 2) != "id") or s.text(k) == "::" or s.text(k - 1) == "operator":
                    break
                typ, i = s.span(i, k - 1), k
            elif t == "::" and typ is None and s.kind(i + 1) == "id":
                k = self.qualified(i + 1, end)
                typ, i = s.span(i, k - 1), k
            else:
                break
        return i, typ, struct, extern, body

    def qualified(self, i: int, end: int) -> int:
        """After ``a::b<c>::d`` at i; before a last ``::~`` or ``::operator``."""
        s, k = self.s, i + 1
        if s.text(k) == "<":
            k = max(s.angles(k, end), k)
        while s.text(k) == "::" and s.kind(k + 1) == "id" and s.text(k + 1) != "operator":
            k += 2
            if s.text(k) == "<":
                k = max(s.angles(k, end), k)
        return k

    # declarations
    def declaration(self, i: int, end: int, how: str) -> int:
        s, start = self.s, i
        if s.kind(i) != "id" and s.text(i) not in ("~", "::"):
            return s.skip(i)
        i, typ, struct, extern, body = self.specifiers(i, end)
        if s.text(i) in ("=", ".", "->", "<<", ">", "+", "-", "(") and typ is not None and s.text(i) != "(" and i > start:
            return max(min(s.find(i, end, {";", "{"}), end), i)
        first = True
        while i < end:
            t = s.text(i)
            if t in (";", "}"):
                return i + 1
            if t == ",":
                i, first = i + 1, False
                continue
            n, name, at, params, pointers, reference, array, owner = self.declarator(i, end)
            if n <= i:
                return max(s.skip(i), start + 1)
            if params >= 0 and not (how == "code" and typ is None):
                after = self.after_params(s.close[params] + 1, end)
                brace = s.text(after) in ("{", ":") and (s.text(after) == "{" or how != "code")
                if brace and first:
                    return self.function(start, at, name, owner, typ, struct, params, after, end, how, pointers)
                self.prototype(start, at, name, owner, typ, struct, params, how, pointers)
                i = after
                continue
            if how == "fields":
                if name and not array:
                    self.field(start, name, typ, struct, pointers, "m")
            elif name and (typ is not None or body or extern) and not pointers and not array and not owner:
                kind = "x" if extern else "l" if self.local() else "v"
                self.tag(name, kind, at, n - 1, [("typeref", typ if struct else f"typename:{typ}")] if typ else [])
            i = n
            if s.text(i) in ("=", "{", ":", "("):
                i = s.find(i + (s.text(i) in ("=", ":")), end, {",", ";"}) if s.text(i) != "{" else s.close[i] + 1
            elif s.text(i) not in (",", ";"):
                stop = s.find(i, end, {";", "{"})
                return stop + 1 if s.text(stop) == ";" else max(stop, i + 1)
        return end

    def declarator(self, i: int, end: int) -> tuple:
        """(after, name, its index, parameters or -1, pointers, reference, array, owner) of a declarator."""
        s, k = self.s, i
        pointers, reference, array, owner, params = 0, False, False, None, -1
        while s.text(k) in ("*", "&", "&&", "const", "volatile", "restrict", "__restrict"):
            pointers += s.text(k) == "*"
            reference = reference or s.text(k) in ("&", "&&")
            k += 1
        at, name = k, ""
        if s.text(k) == "(" and s.text(k + 1) in ("*", "&", "^"):
            return s.skip(s.close[k] + 1) if s.text(s.close[k] + 1) == "(" else s.close[k] + 1, "", k, -1, 1, False, False, None
        while s.kind(k) == "id" and s.text(k + 1) in ("::", "<") and s.text(k) != "operator":
            n = s.angles(k + 1, end) if s.text(k + 1) == "<" else k + 1
            if s.text(n) != "::":
                break
            owner, k = s.text(k), n + 1
        if s.text(k) == "operator":
            n = k + 1
            if s.text(n) == "(" and s.text(n + 1) == ")":
                n += 2
            else:
                while n < end and s.text(n) not in ("(", ";", "{"):
                    n += 1
            name, at, k = "operator" + s.span(k + 1, n - 1).replace("operator", "", 1), k, n
        elif s.text(k) == "~" and s.kind(k + 1) == "id":
            name, at, k = "~" + s.text(k + 1), k, k + 2
        elif s.kind(k) == "id" and s.text(k) not in STATEMENTS:
            name, at, k = s.text(k), k, k + 1
        else:
            return i, "", i, -1, 0, False, False, None
        if s.text(k) == "(" and self.parameters(k):
            params, k = k, s.close[k] + 1
        while s.text(k) == "[":
            array, k = True, s.close[k] + 1
        return k, name, at, params, pointers, reference, array, owner

    def parameters(self, k: int) -> bool:
        """Whether parentheses hold parameter types rather than an initial value."""
        s = self.s
        if s.close[k] == k + 1:
            return True
        return s.kind(k + 1) not in ("num", "str") and s.text(k + 1) not in ("-", "!", "&", "*", "{", "new", "this", "nullptr", "true", "false")

    def after_params(self, k: int, end: int) -> int:
        s = self.s
        while k < end:
            t = s.text(k)
            if t in ("const", "volatile", "override", "final", "noexcept", "&", "&&", "mutable", "try", "__attribute__", "throw") or t == "[" or t == "(" and s.text(k - 1) in ("noexcept", "throw", "__attribute__"):
                k = s.skip(k)
            elif t == "->":
                k = s.find(k, end, {"{", ";", "="})
            elif t == "=" and s.text(k + 1) in ("0", "default", "delete"):
                k += 2
            elif s.kind(k) == "id" and t not in STATEMENTS and s.text(k + 1) in ("{", ";", "("):  # a macro
                k = s.skip(k + 1) if s.text(k + 1) == "(" else k + 1
            else:
                return k
        return end

    @staticmethod
    def spaced(name: str) -> str:
        return "operator " + name[8:].lstrip() if name.startswith("operator") and len(name) > 8 else name

    def type_field(self, typ: str | None, struct: bool) -> list[tuple[str, str]]:
        # template types give functions no typeref, and struct types none either
        return [("typeref", f"typename:{typ}")] if typ and not struct and not ("<" in typ and "::" not in typ) else []

    def function(self, start: int, at: int, name: str, owner: str | None, typ: str | None, struct: bool, params: int, after: int, end: int, how: str, pointers: int) -> int:
        s = self.s
        body = after
        if s.text(body) == ":":
            body += 1
            while body < end and s.text(body) != "{" or s.text(body) == "{" and s.kind(body - 1) == "id" and s.text(s.close[body] + 1) in (",", "{"):
                body = s.skip(body)
        if body >= end:
            return end
        last = s.close[body]
        shown = self.spaced(name) if owner or how == "fields" else name
        if not pointers:
            self.parameter_tags(params, shown if owner else name)
            self.tag(shown if owner else name, "f", start, last, [*self.type_field(typ, struct), *([("class", owner)] if owner else [])])
        self.inside(("function", shown) if not pointers else None, body + 1, last, "code")
        return last + 1

    def prototype(self, start: int, at: int, name: str, owner: str | None, typ: str | None, struct: bool, params: int, how: str, pointers: int) -> None:
        if how == "fields":
            self.field(start, self.spaced(name), typ, struct, pointers, "p")
        elif not pointers and not owner:
            self.parameter_tags(params, name)
            self.tag(name, "p", at, self.s.close[params], [("typeref", typ if struct else f"typename:{typ}")] if typ else [])

    def field(self, start: int, name: str, typ: str | None, struct: bool, pointers: int, kind: str) -> None:
        extra = []
        if typ and not ("<" in typ and "::" not in typ):
            extra.append(("typeref", f"{typ} *" if pointers and kind == "m" else f"typename:{typ}"))
        if pointers and kind == "p":
            return
        self.tag(name, kind, start, None, extra)

    def parameter_tags(self, params: int, name: str) -> None:
        s = self.s
        # a function of a class names its parameters' function with the class
        inner = self.scopes[-1] if self.scopes else ("", "")
        where = f"{inner[1]}::{name}" if inner[0] == "class" else name
        for a, b in s.parts(params + 1, s.close[params]):
            k, typ, struct, _, _ = self.specifiers(a, b)
            if k < b:
                _, n, at, _, _, _, array, _ = self.declarator(k, b)
                if n and not array:
                    self.tag(n, "z", at, at, [*([("typeref", f"typename:{typ}")] if typ and not struct and not ("<" in typ and "::" not in typ) else []), ("function", where)])

    def typedef(self, i: int, end: int) -> int:
        s, start = self.s, i
        unnamed = s.text(i + 1) == "struct" and s.text(i + 2) == "{"
        if unnamed:  # the alias takes a number, its struct the next
            self.anonymous += 1
            number = self.anonymous
        k, typ, struct, _, body = self.specifiers(i + 1, end)
        stop = s.find(k, end, {";"})
        ref = typ if struct else f"typename:{typ}" if typ and (typ in PRIMITIVE or "::" in typ or typ.split()[0] in SIZED) else None
        if unnamed:
            ref = f"struct:__anon{djb2(self.opt.file_name)}{number:02x}08"
        name = ""
        if s.text(k) == "(" and s.text(k + 1) == "*" and s.text(s.close[k] + 1) == "(":
            o = s.close[k] + 1
            name = s.text(k + 2)
            ref = "typename:void (*)" + s.span(o, s.close[o])
        else:
            names = [j for j in range(k, stop) if s.kind(j) == "id" and s.text(j - 1) != "["]
            if names and s.text(k) not in ("*", "(") and s.text(names[-1] + 1) in (";", ","):
                name = s.text(names[-1])
        self.tag(name, "t", start, stop, [("typeref", ref)] if ref else [])
        return stop + 1


def extract(src: Source, opt: Options, lang: str = "c++") -> list[Tag]:
    return _Walk(src, opt, lang).run()
