"""JavaScript, and what TypeScript shares with it: statements, class bodies and object literals by matched brackets."""

from __future__ import annotations

import re

from .base import Fields, Lexer, Options, Source, Stream, Tag, djb2

VALUE_ENDS = {")", "]", "}"}
WORDS_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}


def _regex_may_follow(kind: str, text: str) -> bool:
    if kind == "id":
        return text in WORDS_BEFORE_VALUE
    return not kind or kind == "op" and text not in VALUE_ENDS


LEXER = Lexer(
    [
        ("id", r"\#?[^\W\d][\w$]*|\#?\$[\w$]*"),
        ("skip", r"//[^\r\n]*"),
        ("skip", r"/\*.*?(?:\*/|\Z)"),
        ("str", r"`(?:\\.|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\}|[^`\\])*`?"),
        ("str", r"\"(?:\\.|[^\\\"\r\n])*\"?|'(?:\\.|[^\\'\r\n])*'?"),
        ("regex", r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[a-z]*"),
        ("num", r"\d[\w.]*"),
        ("op", r"=>|\?\.|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^]="),
    ],
    regex_after=_regex_may_follow,
)
_escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v"}


def string_value(literal: str) -> str:
    body = literal[1:-1] if len(literal) > 1 and literal[-1] == literal[0] else literal[1:]

    def one(m: re.Match) -> str:
        s = m[1]
        return chr(int(s[1:], 16)) if len(s) > 1 else _escapes.get(s, s)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", one, body, flags=re.S)


def identifier_text(value: str) -> str:
    """A string as a tag name: no space at its end, control characters and a leading space or ! escaped."""
    v = value.rstrip().replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return "\\x20" + v[1:] if v.startswith(" ") else "\\x21" + v[1:] if v.startswith("!") else v


class Walk:
    """One pass over the tokens. Subclasses say what becomes of a definition (``tag``) and of their own syntax."""

    def __init__(self, src: Source, opt: Options):
        self.s, self.opt, self.tags = Stream(src, LEXER), opt, []
        self.scopes: list[tuple[str, str]] = []
        self.anonymous = 0

    def run(self) -> list[Tag]:
        self.code(0, len(self.s))
        return self.tags

    # what differs by language
    def tag(self, name: str, kind: str, i: int, last: int, extra: list[tuple[str, str]] = ()) -> None:
        if not name or kind not in self.opt.kinds:
            return
        o, f, row = self.opt, Fields(), self.s.row(i)
        if o.on("kind"):
            f.put("kind", kind)
        if o.on("line"):
            f.put("line", str(row + 1))
        if o.scope:
            for k, n in self.scopes:
                f.put(k, n)
        if o.on("scope"):
            for k, v in extra:
                f.put(k, v)
        self.tags.append(Tag(name, row, kind, f.list()))

    def declaration(self, i: int, end: int) -> int:
        """Syntax of the language's own at token i: the index after it, or i."""
        return i

    def inside(self, scope: tuple[str, str] | None, i: int, end: int, how=None) -> None:
        if scope:
            self.scopes.append(scope)
        (how or self.code)(i, end)
        if scope:
            self.scopes.pop()

    # shapes of values
    def function_at(self, i: int) -> bool:
        s = self.s
        i += s.text(i) == "async" and s.text(i + 1) != "=>"
        if s.text(i) == "function":
            return s.text(i + 1) != "*"
        if s.kind(i) == "id":
            return s.text(i + 1) == "=>"
        if s.text(i) == "<":
            i = s.angles(i, len(s))
        if s.text(i) == "(":
            k = s.close[i] + 1
            if s.text(k) == ":":
                k = self.type_end(k + 1, len(s))
            return s.text(k) == "=>"
        return False

    def type_end(self, i: int, end: int) -> int:
        """After a type annotation that begins at i."""
        s = self.s
        while i < end:
            t = s.text(i)
            if t in (",", ";", "=", ")", "]", "}", "=>") or t == "{" and s.text(i - 1) not in (":", "|", "&", "<", ",", "("):
                return i
            if t == "<":
                i = max(s.angles(i, end), i + 1)
            elif t == "(" and s.text(s.close[i] + 1) == "=>":
                i = s.close[i] + 2
            else:
                i = s.skip(i)
        return end

    def value_end(self, i: int, end: int) -> int:
        """After the expression at i: a comma or semicolon, or a new line where it can end."""
        s = self.s
        k = i
        while k < end:
            t = s.text(k)
            if t in (",", ";", ")", "]", "}"):
                return k
            if k > i and s.row(k) > s.end_row(k - 1):
                kind, text = s.kind(k - 1), s.text(k - 1)
                closed = kind in ("id", "num", "str") and text not in WORDS_BEFORE_VALUE or text in VALUE_ENDS or text in ("++", "--")
                if closed and not (s.kind(k) == "op" and t not in ("{", "++", "--", "!", "~", "@", "#")):
                    return k
            k = s.skip(k)
        return min(k, end)

    # statements and expressions
    def code(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            t, before = s.text(i), s.text(i - 1) if i else ""
            own = self.declaration(i, end)
            if own > i:
                i = own
            elif t == "function" and before != ".":
                i = self.function(i, end)
            elif t == "class" and before != "." and (s.kind(i + 1) == "id" or s.text(i + 1) == "{"):
                i = self.klass(i, end)
            elif t in ("var", "let", "const") and (s.kind(i + 1) == "id" or s.text(i + 1) in ("{", "[")) and before != ".":
                i = self.variables(i, end)
            elif t == "{":
                if self.is_object(i):
                    self.object(i + 1, s.close[i])
                else:
                    self.code(i + 1, s.close[i])
                i = s.close[i] + 1
            elif t == "(" and self.immediate(i):
                i = s.close[i] + 1
            elif s.kind(i) == "id" and s.text(i + 1) in (".", "[") and (i == 0 or before in (";", "}", "{", ")") or s.row(i) > s.end_row(i - 1)):
                i = self.assignment(i, end)
            else:
                i += 1

    def is_object(self, i: int) -> bool:
        kind, text = self.s.kind(i - 1), self.s.text(i - 1)
        return kind == "op" and text not in (")", "}", "{", ";", "=>", "]", ">") or kind == "id" and text in ("return", "default", "typeof", "of", "in")

    def immediate(self, i: int) -> bool:
        """``(function () {...})()``: the parentheses at i hold a function that is called."""
        s = self.s
        close = s.close[i]
        if self.function_at(i + 1) and s.text(close + 1) == "(" and not (s.text(i + 1) == "(" and s.text(i - 1) == ""):
            self.anonymous_function(i + 1, close)
            return True
        return False

    def anonymous_function(self, i: int, end: int) -> None:
        self.anonymous += 1
        name = f"anonymousFunction{djb2(self.opt.file_name)}{self.anonymous:02x}"
        self.tag(name, "f", i, end)
        self.inside(("function", name), i + 1, end)

    def function(self, i: int, end: int) -> int:
        s = self.s
        star = s.text(i + 1) == "*"
        k = i + 1 + star
        named = s.kind(k) == "id"
        paren = s.find(k, end, {"("})
        brace = s.find(s.skip(paren) if paren < end else end, end, {"{", ";"})
        if brace >= end or s.text(brace) != "{":
            return k + 1
        last = s.close[brace]
        called = s.text(last + 1) == "(" and not named
        if called and self.statement_start(i):
            self.anonymous_function(i, last)
            return last + 1
        declared = named and (i == 0 or self.statement_start(i) or s.text(i - 1) in ("async", "export", "default"))
        if declared:
            self.tag(s.text(k), "g" if star else "f", i, last)
        self.inside(("function", s.text(k)) if declared else None, paren + 1, last)
        return last + 1

    def statement_start(self, i: int) -> bool:
        s = self.s
        if i == 0 or s.text(i - 1) in (";", "{", "}", ")"):
            return True
        return s.row(i) > s.end_row(i - 1) and not (s.kind(i - 1) == "op" and s.text(i - 1) not in VALUE_ENDS)

    def variables(self, i: int, end: int) -> int:
        s, constant = self.s, self.s.text(i) == "const"
        k = i + 1
        while k < end:
            if s.text(k) in ("{", "["):
                after = s.close[k] + 1
                name = ""
            elif s.kind(k) == "id":
                after, name = k + 1, s.text(k)
            else:
                return k
            at = k
            if s.text(after) == "!":
                after += 1
            if s.text(after) == ":":
                after = self.type_end(after + 1, end)
            value = after + 1 if s.text(after) == "=" else None
            stop = self.value_end(value, end) if value is not None else after
            function = value is not None and self.function_at(value)
            if name:
                self.variable(name, at, stop - 1, function, constant)
            if value is not None:
                self.inside(("function", name) if function and name else None, value + (s.text(value) == "function"), stop)
            if s.text(stop) != ",":
                return max(stop, k + 1)
            k = stop + 1
        return k

    def variable(self, name: str, at: int, last: int, function: bool, constant: bool) -> None:
        self.tag(name, "f" if function else "C" if constant else "v", at, last)

    def assignment(self, i: int, end: int) -> int:
        """``a.b.c = value`` as a statement."""
        s, k = self.s, i
        while s.kind(k) == "id" and s.text(k + 1) == "." and k + 2 < end:
            k += 2
        if k == i or s.text(k + 1) != "=" or s.kind(k) != "id":
            return i + 1
        full, value = s.span(i, k).replace(" ", ""), k + 2
        parts = full.split(".")
        stop = self.value_end(value, end)
        function, obj = self.function_at(value), s.text(value) == "{"
        self.member(parts, full, i, stop - 1, function)
        scope = ("property", full) if obj else ("function", parts[-1]) if function else None
        self.inside(scope if self.members else None, value + (s.text(value) == "function"), stop)
        return max(stop, k + 1)

    members = True

    def member(self, parts: list[str], full: str, i: int, last: int, function: bool) -> None:
        extra = []
        if "prototype" in parts[1:] and (function or ".prototype." in full):
            extra.append(("class", ".".join(parts[: parts.index("prototype", 1)])))
        elif function:
            extra.append(("property", ".".join(parts[:-1])))
        self.tag(parts[-1], "m" if function else "p", i, last, extra)

    def klass(self, i: int, end: int) -> int:
        s, name = self.s, self.s.text(i + 1) if self.s.kind(i + 1) == "id" and self.s.text(i + 1) != "extends" else ""
        brace = s.find(i + 1, end, {"{"})
        if brace >= end:
            return i + 1
        self.klass_tag(name, i, s.close[brace])
        self.inside(("class", name) if name else None, brace + 1, s.close[brace], self.class_body)
        return s.close[brace] + 1

    def klass_tag(self, name: str, i: int, last: int) -> None:
        self.tag(name, "c", i, last)

    def key(self, i: int) -> tuple[str, int]:
        """A property's name at i, and the index after it; no name for a computed one."""
        s = self.s
        if s.text(i) == "[":
            return "", s.close[i] + 1
        if s.kind(i) == "str":
            return identifier_text(string_value(s.text(i))), i + 1
        if s.kind(i) in ("id", "num"):
            return s.text(i), i + 1
        return "", i + 1

    MODIFIERS = {"static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "declare", "override", "abstract"}

    def class_body(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            if s.text(i) in (";", ",", "}"):
                i += 1
                continue
            if s.text(i) == "@":
                i += 2
                if s.text(i) == "(":
                    i = s.skip(i)
                continue
            start, words = i, []
            while s.text(i) in self.MODIFIERS and s.text(i + 1) not in ("(", "=", ";", ",", ":", "?", "}") and (s.text(i) == "*" or s.row(i + 1) == s.row(i) or s.text(i) not in ("get", "set")):
                words.append(s.text(i))
                i += 1
            if words == ["static"] and s.text(i) == "{":
                self.code(i + 1, s.close[i])
                i = s.close[i] + 1
                continue
            at = i
            name, k = self.key(i)
            while s.text(k) in ("?", "!"):
                k += 1
            k = max(k, s.angles(k, end)) if s.text(k) == "<" else k
            if s.text(k) == "(":
                i = self.method(name, words, start, at, k, end)
            else:
                if s.text(k) == ":":
                    k = self.type_end(k + 1, end)
                stop = self.value_end(k + 1, end) if s.text(k) == "=" else k
                function = s.text(k) == "=" and self.function_at(k + 1)
                scope = self.class_field(name, words, start, stop - 1, function)
                if s.text(k) == "=":
                    self.inside(scope, k + 1 + (s.text(k + 1) == "function"), stop)
                i = max(stop, at + 1)

    def method(self, name: str, words: list[str], start: int, at: int, paren: int, end: int) -> int:
        s = self.s
        k = s.close[paren] + 1
        if s.text(k) == ":":
            k = self.type_end(k + 1, end)
        body = s.text(k) == "{"
        last = s.close[k] if body else s.close[paren]
        kind = "G" if "get" in words else "S" if "set" in words else "m"
        self.tag(name, kind, start, last)
        self.inside(("function", name) if name else None, paren + 1, last + (not body))
        return last + 1

    def class_field(self, name: str, words: list[str], start: int, last: int, function: bool) -> tuple[str, str] | None:
        # a field is a field even if its value is a function
        self.tag(name, "M", start, last)
        return None

    def object(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            if s.text(i) == ",":
                i += 1
                continue
            start, words = i, []
            while s.text(i) in ("async", "get", "set", "*") and s.text(i + 1) not in ("(", ",", ":", "}") and i + 1 < end:
                words.append(s.text(i))
                i += 1
            if s.text(i) == "...":
                stop = self.value_end(i + 1, end)
                self.code(i + 1, stop)
                i = stop + 1
                continue
            at = i
            name, k = self.key(i)
            if s.text(at) == "[":
                name = s.span(at, k - 1)
            if s.text(k) == "(":
                i = self.method(name, words, start, at, k, end)
            elif s.text(k) == ":":
                stop = self.value_end(k + 1, end)
                function = self.function_at(k + 1)
                self.pair(name, at, stop - 1, function)
                self.inside(("function", name) if function and name and self.members else None, k + 1 + (s.text(k + 1) == "function"), stop)
                i = max(stop, k + 1)
            else:
                i = max(k, at + 1)

    def pair(self, name: str, at: int, last: int, function: bool) -> None:
        self.tag(name, "m" if function else "p", at, last)


def extract(src: Source, opt: Options) -> list[Tag]:
    return Walk(src, opt).run()
