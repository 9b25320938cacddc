"""Patterns of user grammars' query files, as small trees that ``operators.match`` turns into joins.

Taken are nodes ``(type child ...)``, any node ``(_)`` or ``_``, tokens ``"text"``, fields ``name:``, absent
fields ``!name``, alternations ``[a b]``, the quantifiers ``? * +``, captures ``@name``, the anchor ``.`` and the
predicates ``#eq? #not-eq? #match? #not-match? #any-of?``; other predicates change nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Pattern:
    """One node: its type (None: any), whether only a token of that text, children and what they must be like."""

    type: str | None = None
    token: bool = False
    field: str = ""
    children: tuple["Pattern", ...] = ()
    options: tuple["Pattern", ...] = ()
    absent: tuple[str, ...] = ()
    quantifier: str = ""
    captures: tuple[str, ...] = ()
    #: Nothing may lie between this child and the one before it (or the first), or behind the last.
    adjoins: bool = False
    closes: bool = False
    predicates: tuple[tuple[str, ...], ...] = ()


_TOKEN = re.compile(r"""\s+|;[^\r\n]*|(?P<t>"(?:\\.|[^"\\])*"|\#[\w.?!-]+|@[\w.-]+|![\w]+|[\w-]+(?:/[\w-]+)?:?|[()\[\]?*+.])""")


class PatternError(ValueError):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PatternError(f"unexpected {text[at : at + 20]!r}")
        if m["t"]:
            out.append(m["t"])
        at = m.end()
    return out


def _plain(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), token[1:-1]) if token.startswith('"') else token


@dataclass
class _Reader:
    tokens: list[str]
    at: int = 0
    stack: list[str] = field(default_factory=list)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise PatternError("a query ends inside a pattern")
        self.at += 1
        return self.tokens[self.at - 1]

    def sequence(self, close: str) -> tuple[list[Pattern], list[str], list[tuple[str, ...]], bool]:
        """Patterns up to ``close``, absent fields, predicates, and whether an anchor stands last."""
        found, absent, predicates, anchored = [], [], [], False
        while self.peek() != close:
            t = self.peek()
            if t == ".":
                self.next()
                anchored = True
            elif t.startswith("!"):
                absent.append(self.next()[1:])
            elif t == "(" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].startswith("#"):
                self.next()
                words = []
                while self.peek() != ")":
                    words.append(self.next())
                self.next()
                predicates.append((words[0], *(w if w.startswith("@") else _plain(w) for w in words[1:])))
            else:
                found.append(replace(self.pattern(), adjoins=anchored))
                anchored = False
        self.next()
        return found, absent, predicates, anchored

    def pattern(self) -> Pattern:
        t, name = self.next(), ""
        if t.endswith(":") and t != ":":
            name, t = t[:-1], self.next()
        if t == "[":
            options, _, predicates, _ = self.sequence("]")
            p = Pattern(options=tuple(options), predicates=tuple(predicates))
        elif t == "(":
            first = self.peek()
            if first in ("(", "[") or first.startswith('"'):  # a group: its first pattern, with the predicates
                inner, _, predicates, _ = self.sequence(")")
                if len(inner) != 1:
                    raise PatternError("groups of several patterns are not taken")
                p = replace(inner[0], predicates=(*inner[0].predicates, *predicates))
            else:
                kind = self.next()
                children, absent, predicates, anchored = self.sequence(")")
                if anchored and children:
                    children[-1] = replace(children[-1], closes=True)
                p = Pattern(None if kind == "_" else kind, children=tuple(children), absent=tuple(absent), predicates=tuple(predicates))
        elif t.startswith('"'):
            p = Pattern(_plain(t), token=True)
        elif t == "_":
            p = Pattern()
        else:
            raise PatternError(f"unexpected {t!r}")
        quantifier, captures = "", list(p.captures)
        if self.peek() in ("?", "*", "+"):
            quantifier = self.next()
        while self.peek().startswith("@"):
            captures.append(self.next()[1:])
        return replace(p, field=name or p.field, quantifier=quantifier, captures=tuple(captures))


def parse_patterns(text: str) -> list[Pattern]:
    """The outer patterns of a query, in order. Raises PatternError."""
    reader, out = _Reader(_tokens(text)), []
    while reader.at < len(reader.tokens):
        p = reader.pattern()
        out.append(p)
    return out


def captures_of(p: Pattern) -> list[str]:
    """Every capture in a pattern, once, outer ones first."""
    names = [*p.captures]
    for inner in (*p.children, *p.options):
        names += captures_of(inner)
    return list(dict.fromkeys(names))
