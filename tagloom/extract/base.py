"""What all extractors share: options, tags, scopes, and an error-tolerant lexer with matched brackets.

An extractor is a generator ``extract(source, options) -> Tag``. It never raises on odd
input: what it does not understand it skips.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate


@dataclass
class Options:
    """What to emit: canonical kind letters, field names, extras; the file's name for ``file:`` fields."""

    kinds: frozenset[str] = frozenset()
    fields: frozenset[str] = frozenset({"name", "input", "pattern", "scope", "typeref"})
    qualified: bool = False
    file_scope: bool = False
    file_name: str = ""

    def on(self, name: str) -> bool:
        return name in self.fields

    @property
    def scope(self) -> bool:
        return self.on("scope") or self.qualified


@dataclass
class Tag:
    """A definition: its row counts from 0; fields are ordered pairs with unique keys. No kind: a rule language's."""

    name: str
    row: int
    kind: str | None = None
    fields: list[tuple[str, str]] = field(default_factory=list)
    end: int | None = None


class Fields:
    """Ordered unique pairs; setting a key again changes its value where it stands."""

    def __init__(self) -> None:
        self.pairs: dict[str, str] = {}

    def put(self, key: str, value: str | None, when: bool = True) -> None:
        if when and value is not None:
            self.pairs[key] = value

    def list(self) -> list[tuple[str, str]]:
        return list(self.pairs.items())


_NEW_LINE = re.compile(r"\r\n|\r|\n")


def split_lines(text: str) -> list[str]:
    parts = _NEW_LINE.split(text) if "\r" in text else text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


class Source:
    def __init__(self, text: str):
        self.text = text
        if "\r" in text:
            self.starts = [0] + [m.end() for m in _NEW_LINE.finditer(text)]
        else:
            self.starts = list(accumulate((len(line) + 1 for line in text.split("\n")), initial=0))[:-1]
        self.lines = split_lines(text)

    def row(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1


class Lexer:
    """Tokens of a C-like language. ``spec`` names regexes in order; 'skip' ones are dropped, others name the token's kind: id, num, str, op, nl and so on.

    A 'regex' is a literal (str) where ``regex_after`` says so of the kind and text of the token before (empty if none), else its slash is an op.
    """

    def __init__(self, spec: list[tuple[str, str]], newlines: bool = False, regex_after: Callable[[str, str], bool] | None = None):
        self.regex = next((re.compile(rx) for name, rx in spec if name == "regex"), None)
        # what begins no other token is tried first
        spec = [("op", r"[(){}\[\],;]"), *(x for x in spec if x[0] != "regex"), ("nl", r"\r\n|\r|\n"), ("skip", r"\s+"), ("op", r".")]
        # space before a token is part of its match; the last match is that of the end, without a group
        space = r"[^\S\r\n]*+" if newlines else r"\s*+"
        self.rx = re.compile(space + "(?:" + "|".join(f"({rx})" for _, rx in spec) + r"|\Z)", re.S)
        self.kinds = [None, *(None if name == "skip" or name == "nl" and not newlines else name for name, _ in spec)]
        self.regex_after = regex_after

    def tokens(self, src: Source) -> tuple[list[str], list[str], list[int]]:
        """Texts (a new line's is \\n), kinds and offsets of the tokens."""
        texts: list[str] = []
        kinds: list[str] = []
        starts: list[int] = []
        put_text, put_kind, put_start = texts.append, kinds.append, starts.append
        at, text, n, names = 0, src.text, len(src.text), self.kinds
        while at < n:
            again = n
            for m in self.rx.finditer(text, at):
                group = m.lastindex
                if group is None or (kind := names[group]) is None:
                    continue
                token, start = m[group], m.start(group)
                if kind == "nl":
                    token = "\n"
                elif self.regex is not None and token[0] == "/" and (literal := self.regex.match(text, start)):
                    whole, token = token, "/"
                    if self.regex_after(kinds[-1] if kinds else "", texts[-1] if texts else ""):
                        token, kind = literal[0], "str"
                    again = start + len(token) if token != whole else n
                put_text(token)
                put_kind(kind)
                put_start(start)
                if again < n:
                    break
            at = again
        return texts, kinds, starts


OPENERS = {"(": ")", "[": "]", "{": "}"}
BRACKETS = frozenset("()[]{}")


def match_brackets(texts: list[str], kinds: list[str]) -> list[int]:
    """For each opening bracket the index of its end (the last token if it has none); -1 elsewhere."""
    out, stack = [-1] * len(texts), []
    for i, text in enumerate(texts):
        if text not in BRACKETS or kinds[i] != "op":
            continue
        if text in OPENERS:
            stack.append(i)
        else:
            # an opener of another kind that was never closed is given up
            for k in range(len(stack) - 1, -1, -1):
                if OPENERS[texts[stack[k]]] == text:
                    for j in stack[k + 1 :]:
                        out[j] = i - 1
                    out[stack[k]] = i
                    del stack[k:]
                    break
    for j in stack:
        out[j] = len(texts) - 1
    return out


class _Known(dict):
    """What tokens have by number; nothing outside of them."""

    def __missing__(self, i: int) -> str:
        return ""


class Stream:
    """Tokens with brackets, and helpers to move in them. ``text(i)`` and ``kind(i)`` are empty outside."""

    def __init__(self, src: Source, lexer: Lexer):
        self.src = src
        self.texts, self.kinds, self.starts = lexer.tokens(src)
        self.n = len(self.texts)
        self.text: Callable[[int], str] = _Known(enumerate(self.texts)).__getitem__
        self.kind: Callable[[int], str] = _Known(enumerate(self.kinds)).__getitem__
        # looking a few tokens past the end finds no bracket
        self.close = match_brackets(self.texts, self.kinds) + [-1] * 16

    def __len__(self) -> int:
        return self.n

    def end(self, i: int) -> int:
        """Offset after token i."""
        start = self.starts[i]
        return start + (2 if self.kinds[i] == "nl" and self.src.text.startswith("\r\n", start) else len(self.texts[i]))

    def row(self, i: int) -> int:
        return self.src.row(self.starts[min(i, self.n - 1)])

    def end_row(self, i: int) -> int:
        i = min(max(i, 0), self.n - 1)
        return self.src.row(max(self.starts[i], self.end(i) - 1))

    def span(self, i: int, j: int) -> str:
        """Source text of tokens i to j, j included."""
        return self.src.text[self.starts[i] : self.end(j)] if i <= j < self.n else ""

    def skip(self, i: int) -> int:
        """The index after token i, or after the bracket that it opens."""
        after = self.close[i] if i < self.n else -1
        return after + 1 if after >= 0 else i + 1

    def find(self, i: int, end: int, stop: set[str]) -> int:
        """First token from i, outside brackets, whose text is in ``stop``; ``end`` if none."""
        texts, close = self.texts, self.close
        last = min(end, self.n)
        while i < last:
            if texts[i] in stop and self.kinds[i] in ("op", "nl", "id"):
                return i
            i = close[i] + 1 if close[i] >= 0 else i + 1
        return end

    def angles(self, i: int, end: int) -> int:
        """Index after the angle brackets that open at i (i itself if none open or they do not end)."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < end:
            t = self.text(k)
            if t == "<":
                depth += 1
            elif t in (">", ">>"):
                depth -= len(t)
                if depth <= 0:
                    return k + 1
            elif t in ("{", ";"):
                return i
            k = self.skip(k) if t in OPENERS else k + 1
        return i

    def parts(self, i: int, end: int, by: str = ",") -> Iterator[tuple[int, int]]:
        """(first, after last) of the pieces between ``by`` outside all brackets, angle brackets too."""
        start = i
        while i < end:
            if self.text(i) == by:
                yield start, i
                start = i + 1
            nxt = self.angles(i, end) if self.text(i) == "<" else i
            i = nxt if nxt > i else self.skip(i)
        if start < end:
            yield start, end


def squeeze(text: str) -> str:
    return " ".join(text.split())


def djb2(name: str) -> str:
    h = 5381
    for b in name.encode():
        h = (h * 33 + b) & 0xFFFFFFFF
    return f"{h:08x}"
