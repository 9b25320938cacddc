"""Languages that rules describe: each rule finds names on lines, without kinds or fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import Options, Source, Tag

W = r"[^\W\d]\w*"
_M = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|readonly|const|partial|extern|unsafe|new|volatile|default|synchronized|native|case|implicit|lazy|open|pub|opaque|inline|transparent)\s+)*"
_CS = r"[\w.<>\[\],?]+"

# Fixed values: (regex, flags) a language; group 1 (or the only matched group) is the name.
RULES: dict[str, list[str]] = {
    "shell": [rf"(?m)^[ \t]*function[ \t]+([\w:.+-]+)", r"(?m)^[ \t]*([\w:.+-]+)[ \t]*\(\)", r"<<-?[ \t]*[\"']?(\w+)", r"(?m)(?:^|[;&|])[ \t]*alias[ \t]+([^\s=]+=)(?=[\"'$])"],
    "c#": [
        rf"\b(?:class|interface|enum|namespace)\s+(?!where\b)((?:{W}\.)*{W})",
        rf"\brecord\s+(?:class\s+|struct\s+)?({W})",
        rf"\bdelegate\s+{_CS}\s+({W})",
        rf"\bevent\s+{_CS}\s+({W})",
        rf"(?m)^[ \t]*{_M}(?!return\b|new\b|else\b|throw\b|await\b|using\b|class\b|enum\b|record\b|interface\b|namespace\b|delegate\b|event\b){_CS}[ \t]+({W})[ \t]*(?:<[^>()]*>)?[ \t]*\(",
        rf"(?m)^[ \t]*{_M}({W})[ \t]*\([^()]*\)[ \t]*(?::[^{{;]*)?\{{",
        rf"(?m)^[ \t]*{_M}(?!return\b|using\b|event\b){_CS}[ \t]+({W})[ \t]*(?:\{{[ \t]*(?:get|set|init)\b|=>)",
    ],
    "scala": [rf"\b(?:class|object|trait|enum|given)\s+({W})", rf"\bdef\s+({W}|[^\s\w(\[:=]+)(?=[^\n]*[={{])", rf"\b(?:val|var)\s+({W})", rf"\btype\s+({W})", rf"(?m)^\s*package\s+([\w.]+)"],
    "julia": [rf"\b(?:mutable\s+)?struct\s+({W})", rf"\b(?:abstract|primitive)\s+type\s+({W})", rf"(?<![\w.@])({W}!?)\("],
    "gleam": [rf"\bfn\s+({W})\s*\(", r"(?m)^\s*(?:pub\s+)?(?:opaque\s+)?type\s+([A-Z]\w*)(?![^\n{]*=)"],
    "ruby": [rf"(?m)^\s*(?:class|module)\s+(?:\w+::)*([A-Z]\w*)", rf"(?m)^\s*(?:(?:private|protected|public|module_function)\s+)?def\s+(?:self\.|[\w:]+\.)?({W}[?!=]?|[-+*/%<=>!~^&|\[\]]+)", rf"\balias(?:_method)?\s+:?({W}[?!=]?)"],
    "java": [rf"\b(?:class|interface|enum|record)\s+({W})", rf"(?m)^[ \t]*{_M}(?:<[^>()]*>\s*)?(?!return\b|new\b|else\b|throw\b)[\w.<>\[\],?]+[ \t]+({W})[ \t]*\([^;{{]*\)[^;{{]*[;{{]"],
    "ocaml": [rf"(?m)^\s*(?:let|and)\s+(?:rec\s+)?({W})", rf"(?m)^\s*(?:module|module\s+type|class|exception|external|method|val)\s+(?:virtual\s+)?({W})", rf"(?m)^\s*(?:type|and)\s+(?:'\w+\s+|\([^)]*\)\s+)?({W})"],
    "php": [rf"\bfunction\s+&?\s*({W})", rf"(?m)^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+({W})", rf"(?m)^\s*namespace\s+([\w\\]+)"],
    "elixir": [r"\b(?:defmodule|defprotocol|defimpl)\s+([\w.]+)", rf"\b(?:def|defp|defmacro|defmacrop|defguard|defguardp|defdelegate)\s+({W}[?!]?)"],
    "lua": [rf"\bfunction\s+([\w.:]+)\s*\(", rf"(?m)^\s*(?:local\s+)?({W}(?:\.{W})*)\s*=\s*function\b"],
}
COMMENTS: dict[str, str] = {
    "shell": r"(?m)(?:^|(?<=\s))\#[^\r\n]*",
    "ruby": r"(?m)\#[^\r\n{][^\r\n]*|^=begin.*?^=end[^\r\n]*",
    "julia": r"(?s)\#=.*?=\#|\#[^\r\n]*",
    "elixir": r"\#[^\r\n]*",
    "ocaml": r"(?s)\(\*.*?\*\)",
    "lua": r"(?s)--\[\[.*?\]\]|--[^\r\n]*",
    "php": r"(?s)//[^\r\n]*|\#(?!\[)[^\r\n]*|/\*.*?\*/",
}
C_COMMENT = r"(?s)//[^\r\n]*|/\*.*?\*/"


def _blank(m: re.Match) -> str:
    """Comments and strings become spaces, so that offsets stay."""
    return re.sub(r"[^\r\n]", " ", m[0])


def _strings(lang: str, text: str) -> str:
    if lang in ("shell",):
        return text
    return re.sub(r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\r\n])*\"", lambda m: m[0][0] + _blank(m)[1:-1] + m[0][-1], text, flags=re.S)


def _enum_members(text: str) -> Iterator[tuple[str, int]]:
    for m in re.finditer(r"\benum\s+\w+[^{;]*\{([^{}]*)\}", text):
        for n in re.finditer(rf"(?:^|,)\s*({W})", m[1]):
            yield n[1], m.start(1) + n.start(1)


def _cs_fields(text: str) -> Iterator[tuple[str, int]]:
    """Names of fields of types: declarations outside method bodies."""
    rx = re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|readonly|const|volatile)\s+)+(?!event\b|class\b|enum\b){_CS}[ \t]+({W})[ \t]*(?:=[^>]|;|,)")
    for m in rx.finditer(text):
        yield m[1], m.start(1)


def _scala_parameters(text: str) -> Iterator[tuple[str, int]]:
    for m in re.finditer(rf"\bclass\s+\w+(?:\[[^\]]*\])?\s*\(([^()]*)\)", text):
        for n in re.finditer(rf"(?:^|,)\s*(?:(?:val|var|private|protected|override|implicit)\s+)*({W})\s*:", m[1]):
            yield n[1], m.start(1) + n.start(1)


def _gleam_constructors(text: str) -> Iterator[tuple[str, int]]:
    for m in re.finditer(r"\btype\s+[A-Z]\w*(?:\([^)]*\))?\s*\{", text):
        depth, k = 1, m.end()
        while k < len(text) and depth:
            c = text[k]
            if depth == 1 and (n := re.match(r"[A-Z]\w*", text[k:])) and not text[k - 1].isalnum():
                yield n[0], k
                k += len(n[0])
                continue
            depth += (c in "{(") - (c in "})")
            k += 1


def _swallowed(text: str, at: int) -> bool:
    """Whether what begins here belongs to a declaration before it that closes its list and never ends."""
    before = text[:at].rstrip()
    return before.endswith(")") and re.search(r"\b(?:record|class|struct)\b[^;{}]*$", before) is not None


MORE = {"c#": (_enum_members, _cs_fields), "scala": (_scala_parameters,), "gleam": (_gleam_constructors,)}


def extract(src: Source, opt: Options, lang: str) -> list[Tag]:
    """Names in order of place; a name found twice at one place is one tag."""
    text = re.sub(COMMENTS.get(lang, C_COMMENT), _blank, src.text)
    text = _strings(lang, text)
    found: dict[tuple[int, str], None] = {}
    for rule in RULES.get(lang, ()):
        for m in re.finditer(rule, text):
            if m[1] and not (lang == "c#" and _swallowed(text, m.start())):
                found[(m.start(1), m[1])] = None
    for more in MORE.get(lang, ()):
        for name, at in more(text):
            found[(at, name)] = None
    return [Tag(name, src.row(at)) for at, name in sorted(found)]


def echo(src: Source, opt: Options) -> list[Tag]:
    """The test language: one tag of a fixed name on the first line."""
    return [Tag("echo_tag", 0, "f")]
