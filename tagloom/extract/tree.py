"""Syntax trees for user queries: brackets, tokens and the declarations that keywords begin.

A tree is no full parse. Its inner nodes are bracket groups and declarations; a declaration
goes from its keyword to the end of its block or statement and has ``name``, ``parameters``
and ``body`` children as fields. What a grammar calls these types differs by language and is
in DECLARATIONS; names of leaves and groups are matched by family (``FAMILIES``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import OPENERS, Lexer, Source, Stream

# Keyword -> type of the declaration that it begins, by language.
DECLARATIONS: dict[str, dict[str, str]] = {
    "c": {"struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier"},
    "c++": {"class": "class_specifier", "struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier", "namespace": "namespace_definition"},
    "c#": {"class": "class_declaration", "struct": "struct_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration", "namespace": "namespace_declaration"},
    "gleam": {"fn": "function", "type": "type_definition", "const": "constant"},
    "go": {"func": "function_declaration", "type": "type_declaration", "var": "var_declaration", "const": "const_declaration"},
    "java": {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"},
    "javascript": {"function": "function_declaration", "class": "class_declaration", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration"},
    "julia": {"struct": "struct_definition", "function": "function_definition", "module": "module_definition", "macro": "macro_definition"},
    "kotlin": {"fun": "function_declaration", "class": "class_declaration", "interface": "class_declaration", "object": "object_declaration", "typealias": "type_alias", "val": "property_declaration", "var": "property_declaration"},
    "lua": {"function": "function_declaration"},
    "php": {"function": "function_definition", "class": "class_declaration", "interface": "interface_declaration", "trait": "trait_declaration", "enum": "enum_declaration"},
    "python": {"def": "function_definition", "class": "class_definition"},
    "rust": {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "impl": "impl_item", "mod": "mod_item", "const": "const_item", "static": "static_item", "type": "type_item"},
    "scala": {"def": "function_definition", "class": "class_definition", "object": "object_definition", "trait": "trait_definition", "val": "val_definition", "var": "var_definition", "type": "type_definition"},
    "shell": {"function": "function_definition"},
    "typescript": {"function": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "type": "type_alias_declaration", "const": "lexical_declaration", "let": "lexical_declaration"},
}
#: Languages whose functions have no keyword: a name, parentheses and a block; and what they are called.
CALLABLE = {"c": "function_definition", "c++": "function_definition", "c#": "method_declaration", "java": "method_declaration", "javascript": "method_definition", "typescript": "method_definition"}
#: Words before parentheses and a block that are no function's name.
CONTROL = frozenset({"if", "for", "while", "switch", "catch", "return", "else", "do", "synchronized", "using", "lock", "fixed", "foreach", "when", "function", "with"})
#: Node type -> regex of the names that grammars give it.
FAMILIES = {
    "identifier": r".*identifier|word|name|constant|variable_name",
    "reference": r"user_type|named_type|type_reference|reference",
    "parentheses": r".*parameters|.*parameter_list|parameter_clause|.*arguments|argument_list|parenthesized_.*|tuple.*|parentheses",
    "braces": r".*body|.*block|.*_list|statements|compound_statement|object|braces",
    "brackets": r".*array.*|list|subscript.*|type_arguments|brackets",
    "string": r".*string.*|.*char.*literal",
    "number": r".*number.*|.*integer.*|.*float.*|.*numeric.*",
}
_HASHED = frozenset({"python", "shell", "julia", "ruby", "elixir"})
_COMMENTS = {True: [("skip", r"\#[^\r\n]*")], False: [("skip", r"//[^\r\n]*"), ("skip", r"/\*.*?(?:\*/|\Z)")]}
_DASHED = [("skip", r"--\[\[.*?(?:\]\]|\Z)|--[^\r\n]*")]
_TOKENS = [("str", r"\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\\\"\r\n])*\"?|'(?:\\.|[^\\'\r\n])*'"), ("id", r"`[^`\r\n]+`|[^\W\d]\w*"), ("num", r"\d[\w.]*"), ("op", r"->|=>|::|[-+*/%=!<>]=|&&|\|\|")]


def lexer_of(lang: str) -> Lexer:
    return Lexer([*(_DASHED if lang == "lua" else _COMMENTS[lang in _HASHED]), *_TOKENS], newlines=True)


LEXERS = {lang: lexer_of(lang) for lang in DECLARATIONS}
#: A tree's rows: its number (in the order of the text), that of its parent, its place among the siblings, type, field, text of a leaf and row.
Node = tuple[int, int, int, str, str, str, int]


class _Tree:
    def __init__(self, src: Source, lang: str):
        self.src, self.lang, self.s = src, lang, Stream(src, LEXERS[lang])
        self.words, self.nodes = DECLARATIONS[lang], []

    def add(self, parent: int, place: int, kind: str, field: str, text: str, at: int) -> int:
        self.nodes.append((at, parent, place, kind, field, text, self.s.row(at) if len(self.s) else 0))
        return len(self.nodes) - 1

    def run(self) -> list[Node]:
        self.inside(self.add(-1, 0, "source", "", "", 0), 0, len(self.s))
        # a parent is made before its children and begins no later
        order = sorted(range(len(self.nodes)), key=lambda k: self.nodes[k][0])
        number = {k: i for i, k in enumerate(order)} | {-1: -1}
        return [(number[k], number[self.nodes[k][1]], *self.nodes[k][2:]) for k in order]

    def inside(self, parent: int, i: int, end: int, place: int = 0) -> int:
        """The nodes of tokens i to end as children of ``parent``; what is nested waits on a list, so depth is no matter."""
        todo = [(parent, i, end, place)]
        last = place
        while todo:
            parent, i, end, place = todo.pop()
            while i < end:
                found = self.declared(i, end)
                if found:
                    kind, name, after = found
                    own = self.add(parent, place, kind, "", "", i)
                    self.members(own, kind, i, name, after, todo)
                    i = after
                else:
                    i = self.one(parent, place, "", i, todo)
                place += self.s.kind(i - 1) != "nl"
            last = place
        return last

    def one(self, parent: int, place: int, field: str, i: int, todo: list, word: str = "identifier") -> int:
        """The node of token i, or of the group that it opens; gives the index after it. ``word`` is the type of a name."""
        s, kind = self.s, self.s.kind(i)
        if kind == "op" and s.text(i) in OPENERS:
            own = self.add(parent, place, {"(": "parentheses", "[": "brackets", "{": "braces"}[s.text(i)], field, "", i)
            after = s.skip(i)
            todo.append((own, i + 1, max(i + 1, after - 1), 0))
            return after
        if kind != "nl":
            text = s.text(i)
            named = {"id": text if text in self.words else word, "num": "number", "str": "string"}.get(kind, text)
            self.add(parent, place, named, field, text.strip("`") if kind == "id" else text, i)
        return i + 1

    def declared(self, i: int, end: int) -> tuple[str, int, int] | None:
        """(type, index of the name, index after all) of the declaration at token i."""
        s, word = self.s, self.s.text(i)
        if s.kind(i) != "id" or (i and s.text(i - 1) in (".", "::", "?.")):
            return None
        if word in self.words:
            k = i + 1
            if self.lang == "go" and s.text(k) == "(":  # a method's receiver
                k = s.skip(k)
            if s.text(k) == "<":
                k = s.angles(k, end)
            while s.kind(k) == "nl" and s.kind(k + 1) == "id":
                k += 1
            if s.kind(k) != "id" or k >= end:
                return None
            if self.lang == "kotlin" and word == "fun":  # a receiver with type arguments
                past = s.angles(k + 1, end)
                while past > k + 1 or s.text(past) == "?":
                    past += s.text(past) == "?"
                    if s.text(past) not in (".", "?.") or s.kind(past + 1) != "id":
                        break
                    k = past + 1
                    past = s.angles(k + 1, end)
            while s.text(k + 1) in (".", "::", ":") and s.kind(k + 2) == "id" and (s.text(k + 1) != ":" or self.lang == "lua"):
                k += 2  # a qualified name, or one with a receiver
            kind = self.words[word]
            if self.lang == "go" and s.text(i + 1) == "(" and word == "func":
                kind = "method_declaration"
            return kind, k, self.ends(k + 1, end, i)
        if self.lang in CALLABLE and word not in CONTROL and s.text(i + 1) == "(" and s.text(i - 1) not in ("new", "=", "return", ".", "->"):
            k = s.skip(i + 1)
            while k < end and (s.kind(k) in ("id", "nl") or s.text(k) in (",", ":", "::", ".", "<", ">", "->", "[", "*", "&")):
                k = s.skip(k)
            if s.text(k) == "{" and k < end:
                return CALLABLE[self.lang], i, s.skip(k)
        return None

    def ends(self, i: int, end: int, first: int) -> int:
        """Index after the declaration whose name is before i: its block's end, or that of its statement."""
        s = self.s
        if self.lang == "python":
            column = self.s.starts[first] - self.src.starts[s.row(first)]
            colon = s.find(i, end, {":"})
            k = colon + 1
            while k < end:
                if s.kind(k) == "nl":
                    after = k
                    while s.kind(after) == "nl":
                        after += 1
                    if after < end and s.starts[after] - self.src.starts[s.row(after)] <= column:
                        return k
                    k = after
                else:
                    k = s.skip(k)
            return min(k, end)
        if self.lang in ("lua", "julia"):
            depth, k, opening = 1, i, {"function", "if", "do", "for", "while", "struct", "module", "begin", "let", "try", "macro", "quote", "repeat"}
            while k < end and depth:
                word, before = s.text(k), s.text(k - 1)
                if s.kind(k) == "id" and before != ".":
                    opens = word in opening and not (self.lang == "lua" and word in ("for", "while")) and not (self.lang == "julia" and word == "do")
                    depth += opens - (word in ("end", "until"))
                k += 1
            return k
        while i < end:
            t = s.text(i)
            if t == "{":
                return s.skip(i)
            if t in (";", "}", ")", ",") or s.kind(i) == "nl" and not self.goes_on(i, end):
                return i
            i = s.skip(i)
        return end

    def goes_on(self, i: int, end: int) -> bool:
        """Whether a statement goes on behind the line's end at i."""
        before, k = self.s.text(i - 1), i
        while k < end and self.s.kind(k) == "nl":
            k += 1
        return before in ("=", "->", ",", ":", "+", "&&", "||") or self.s.text(k) in ("{", ".", "where", "?.", ":", "=", "extends", "implements", "throws")

    def members(self, own: int, kind: str, i: int, name: int, after: int, todo: list) -> None:
        """The children of a declaration: tokens in order, with fields for its name, parameters and body."""
        s, place, k, named, indented = self.s, 0, i, {}, self.lang in ("python", "lua", "julia")
        while k < after:
            if s.kind(k) == "nl":
                k += 1
                continue
            field = ""
            if k == name:
                field = "name"
            elif s.text(k) == "(" and k > name and "parameters" not in named:
                field = "parameters"
            elif s.text(k) == "{" and "body" not in named:
                field = "body"
            starts = indented and k > name and "body" not in named and (s.text(k) == ":" if self.lang == "python" else s.kind(k - 1) == "nl")
            if starts:
                block = self.add(own, place, "braces", "body", "", k)
                todo.append((block, k + (self.lang == "python"), after - (self.lang != "python" and s.text(after - 1) == "end"), 0))
                return
            named[field] = True
            found = self.declared(k, after) if k > name and not field else None
            if found and found[2] > k:
                inner = self.add(own, place, found[0], "", "", k)
                self.members(inner, found[0], k, found[1], found[2], todo)
                k = found[2]
            else:
                k = self.one(own, place, field, k, todo, "identifier" if k == name else "reference")
            place += 1


def nodes_of(text: str, lang: str) -> Iterator[Node]:
    """A tree's nodes; a language that has no table of declarations gives none."""
    if lang in DECLARATIONS:
        yield from _Tree(Source(text), lang).run()


def type_regex(name: str) -> str | None:
    """The family of nodes that a query's type name stands for, if it is no declaration's."""
    return next((family for family, names in FAMILIES.items() if re.fullmatch(names, name)), None)


def known_types(lang: str) -> set[str]:
    """Types of the declarations that trees of a language have."""
    own = {*DECLARATIONS.get(lang, {}).values(), *filter(None, [CALLABLE.get(lang)])}
    return own | {"source", "method_declaration"} if lang == "go" else own | {"source"}
