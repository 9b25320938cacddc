"""Editor mode lines: the file type that a Vim or Emacs setting in a file's first or last lines names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINES = 5
REACH = 4096
_vim = re.compile(r"(?:^|(?<=[ \t]))(?:[vV]im|vi|ex):")
_keys = ("ft=", "filetype=", "syntax=")


def vim_type(line: str) -> str | None:
    """The file type of a Vim mode line: options up to a bare colon after ``set``, else parted by colons."""
    m = _vim.search(line)
    if not m:
        return None
    rest = line[m.end() :].strip()
    form = re.match(r"set? (.*)", rest)
    if form:
        body = re.match(r"(?:\\.|[^:\\])*", form[1])[0]
        options = body.split()
    else:
        options = re.split(r"[:\s]+", rest)
    for option in options:
        for key in _keys:
            if option.startswith(key) and option[len(key) :]:
                return option[len(key) :]
    return None


def emacs_first(line: str) -> str | None:
    m = re.search(r"-\*-(.*?)-\*-", line)
    if not m:
        return None
    body = m[1].strip()
    if ":" not in body and ";" not in body:
        return body or None
    for part in body.split(";"):
        key, colon, value = part.partition(":")
        if colon and key.strip().lower() == "mode" and value.strip():
            return value.strip()
    return None


def emacs_locals(tail: str) -> str | None:
    start = tail.rfind("Local Variables:")
    if start < 0:
        return None
    for line in tail[start:].splitlines()[1:]:
        if "End:" in line:
            return None
        m = re.search(r"(?:^|[^\w-])mode:\s*([^\s;]+)", line, re.I)
        if m:
            return m[1]
    return None


def modeline(head: bytes, tail: bytes) -> str | None:
    """What the head and tail (empty where the head is all) say, in order of precedence."""
    top = head.decode("utf-8", "replace")
    end = tail.decode("utf-8", "replace") if tail else top
    first, last = top.splitlines()[:LINES], end.splitlines()[-LINES:]
    if first and (found := emacs_first(first[0])):
        return found
    for line in [*first, *reversed(last)]:
        if found := vim_type(line):
            return found
    return emacs_locals(end)


def modeline_type(content: Column) -> Column:
    """Arrow-batched: only files that no name has settled reach it."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else modeline(bytes(b[:REACH]), bytes(b[-REACH:]) if len(b) > REACH else b""))

    return run(content)
