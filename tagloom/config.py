"""Command-line configuration: kinds, fields, extras, language maps, option files. All of it runs on the driver."""

from __future__ import annotations

import argparse
import os
import re
import sys
from dataclasses import dataclass, field

from .plans.languages import Edit, Kind, kinds_of

# Field letters and names; letters that are taken without meaning anything.
FIELD_LETTERS = {"n": "line", "S": "signature", "s": "scope", "k": "kind", "a": "access", "f": "file", "e": "end", "t": "typeref", "r": "roles"}
IDLE_LETTERS = set("NFPTCEKRZlmopxz")
DEFAULT_FIELDS = frozenset({"name", "input", "pattern", "scope", "typeref"})
WORKERS = 4


def warn(message: str) -> None:
    print(f"Warning: {message}", file=sys.stderr)


def to_bool(text: str) -> bool | None:
    low = text.lower()
    return True if low in ("yes", "on", "true", "1") else False if low in ("no", "off", "false", "0") else None


def parse_kinds(spec: str, kinds: list[Kind]) -> frozenset[str]:
    """Canonical kinds of a spec: a comma list of letters or names, or a run of letters; ``+`` and ``-`` change the defaults."""
    defaults = {k.canonical for k in kinds if k.default}
    if not spec:
        return frozenset(defaults)
    known: dict[str, str] = {}
    for k in kinds:
        for name in (k.letter, *k.names):
            known.setdefault(name, k.canonical)
    on = set(defaults) if any(c in spec for c in "+-") else set()
    add, items = True, []
    if "," in spec:
        for part in (p.strip() for p in spec.split(",")):
            items.append((part[:1] != "-", part.lstrip("+-")))
    else:
        for c in spec:
            if c in "+-":
                add = c == "+"
            else:
                items.append((add, c))
    for plus, name in items:
        if not name:
            continue
        if name not in known:
            warn(f"unknown kind: {name}")
        elif plus:
            on.add(known[name])
        else:
            on.discard(known[name])
    return frozenset(on)


def parse_fields(spec: str) -> frozenset[str]:
    """Enabled fields: letters in a row, or a comma list with ``+`` and ``-``. ``-r`` turns roles on, as it always did."""
    on = set(DEFAULT_FIELDS)
    if not spec:
        return frozenset(on)
    listed = any(c in spec for c in ",+-")
    for part in [p.strip() for p in spec.split(",")] if listed else list(spec):
        sign, name = (part[0], part[1:]) if part[:1] in ("+", "-") else ("+", part)
        full = FIELD_LETTERS.get(name) or (name if name in FIELD_LETTERS.values() else None)
        if full is None:
            if name and (listed or name in IDLE_LETTERS):
                warn(f"unknown field: {name}")
        elif sign == "+" or full == "roles":
            on.add(full)
        else:
            on.discard(full)
    return frozenset(on)


@dataclass(frozen=True)
class Extras:
    qualified: bool = False
    file_scope: bool = False


def parse_extras(spec: str) -> Extras:
    on = {"qualified": False, "file_scope": False}
    names = {"q": "qualified", "qualified": "qualified", "F": "file_scope", "fileScope": "file_scope"}
    for part in (p.strip() for p in spec.split(",")):
        if part[:1] in ("+", "-") and part[1:] in names:
            on[names[part[1:]]] = part[0] == "+"
    return Extras(**on)


def map_item(language: str, item: str) -> Edit | None:
    """``[+|-].ext``, ``(glob)`` or ``%regex%[i]`` as an edit; a percent sign inside is ``\\%``."""
    op = "add"
    if item[:1] in ("+", "-"):
        op, item = ("add" if item[0] == "+" else "remove"), item[1:]
    if item.startswith("(") and item.endswith(")"):
        return Edit(language, op, "pattern", item[1:-1])
    if item.startswith("%"):
        m = re.match(r"%((?:\\%|[^%])*)%(i|\{icase\})?$", item)
        if not m:
            warn(f"bad map: {item}")
            return None
        rx = m[1].replace("\\%", "%")
        try:
            re.compile(rx)
        except re.error:
            warn(f"bad regex: {rx}")
            return None
        return Edit(language, op, "regex", f"(?i){rx}" if m[2] else rx)
    return Edit(language, op, "ext", item.lstrip(".")) if item.lstrip(".") else None


def langmap(value: str) -> list[Edit]:
    """``L:spec,...``: a spec is a run of ``.ext`` and ``(glob)``; without a leading plus it replaces the language's map."""
    out: list[Edit] = []
    for part in re.split(r",(?![^()]*\))", value):
        language, colon, spec = part.partition(":")
        if not colon or not language.strip():
            warn(f"bad langmap: {part}")
            continue
        if spec.startswith("+"):
            spec = spec[1:]
        else:
            out.append(Edit(language.strip(), "clear"))
        # what is put first must be added last
        for item in reversed(re.findall(r"\([^()]*\)|\.[^.()]+", spec)):
            if edit := map_item(language.strip(), item):
                out.append(edit)
    return out


def option_words(path: str) -> list[str]:
    """Words of an options file, or of a folder's ``*.ctags`` files in order of name; blank and ``#`` lines are skipped."""
    files = [path]
    if os.path.isdir(path):
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".ctags"))
    words: list[str] = []
    for name in files:
        with open(name, encoding="utf-8") as f:
            for line in (x.strip() for x in f):
                if line and not line.startswith("#"):
                    words += line.split()
    return words


def with_options(argv: list[str]) -> list[str]:
    """Arguments with those of the options file before them, so that the command line has the last word."""
    path = None
    for i, a in enumerate(argv):
        if a.startswith("--options="):
            path = a.split("=", 1)[1]
        elif a == "--options" and i + 1 < len(argv):
            path = argv[i + 1]
    return [*option_words(path), *argv] if path else argv


def exclude_patterns(values: list[str]) -> list[str]:
    """Patterns; of ``@file`` both the name itself and each line of the file."""
    out: list[str] = []
    for v in values:
        out.append(v)
        if v.startswith("@") and os.path.exists(v[1:]):
            with open(v[1:], encoding="utf-8") as f:
                out += [x.strip() for x in f if x.strip()]
    return out


@dataclass
class Config:
    files: list[str] = field(default_factory=list)
    tag_file: str = "tags"
    append: bool = False
    recurse: bool = True
    sort: bool = True
    excludes: list[str] = field(default_factory=list)
    workers: int = WORKERS
    fields: frozenset[str] = DEFAULT_FIELDS
    extras: Extras = field(default_factory=Extras)
    kinds: dict[str, str] = field(default_factory=dict)
    edits: list[Edit] = field(default_factory=list)
    force: str = ""
    guess: bool = False
    plugin_dirs: list[str] = field(default_factory=list)
    #: Languages, or names of plugins, whose tags are kept from run to run; ``all`` stands for every one.
    cached: list[str] = field(default_factory=list)
    user_grammars: str = ""
    index: str = ""
    command: str = ""
    argument: str = ""

    def kinds_for(self, language: str) -> frozenset[str]:
        return parse_kinds(self.kinds.get(language.lower(), ""), kinds_of(language))


def _dynamic(argv: list[str]) -> tuple[list[str], dict[str, str], list[Edit]]:
    """``--kinds-L``, ``--L-kinds`` of old and ``--map-L`` flags, which name their language in the flag."""
    rest, kinds, edits, i = [], {}, [], 0
    while i < len(argv):
        a = argv[i]
        m = re.match(r"--(?:kinds-([^=]+)|(rust|go)-kinds|map-([^=]+))(?:=(.*))?$", a, re.S)
        if not m:
            rest.append(a)
        else:
            value = m[4]
            if value is None:
                i += 1
                value = argv[i] if i < len(argv) else ""
            if m[3]:
                edits += [e for e in [map_item(m[3], value)] if e]
            else:
                kinds[(m[1] or m[2]).lower()] = value  # the last one holds
        i += 1
    return rest, kinds, edits


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tagloom", allow_abbrev=False)
    p.add_argument("-f", dest="tag_file", default="tags")
    for name in ("--append", "--sort"):
        p.add_argument(name, nargs="?", const="true", default="false" if name == "--append" else "true")
    p.add_argument("-R", "--recurse", nargs="?", const="true", default="true")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--workers", type=int, default=WORKERS)
    p.add_argument("--max-parallelism", action="store_true")
    for name in ("--options", "--extras", "--format", "--excmd", "--fields", "--language-force", "--user-languages-config", "--plugins-dir", "--plugin-index-url"):
        p.add_argument(name, default="")
    p.add_argument("-G", "--guess-language-eagerly", action="store_true")
    p.add_argument("--langmap", action="append", default=[])
    p.add_argument("--plugin-dir", action="append", default=[])
    p.add_argument("--plugin-cache", action="append", default=[])
    for name in ("--print-language", "--list-languages", "--suggest-plugins"):
        p.add_argument(name, action="store_true")
    for name in ("--list-maps", "--list-kinds"):
        p.add_argument(name, nargs="?", const="", default=None)
    p.add_argument("files", nargs="*")
    return p


@dataclass
class PluginCommand:
    action: str
    name: str = ""
    force: bool = False
    refresh: bool = False
    folder: str = ""
    folders: list[str] = field(default_factory=list)
    index: str = ""


def plugin_args(argv: list[str]) -> PluginCommand:
    """``plugin <action> [name]``, with its flags in any place."""
    p = argparse.ArgumentParser(prog="tagloom plugin", allow_abbrev=False)
    p.add_argument("action", choices=("available", "install", "uninstall", "installed", "update"))
    p.add_argument("name", nargs="?", default="")
    for flag in ("--force", "--refresh"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--plugins-dir", default=os.path.expanduser("~/.config/tagloom/plugins"))
    p.add_argument("--plugin-dir", action="append", default=[])
    p.add_argument("--plugin-index-url", default="")
    a = p.parse_args(argv)
    if a.action in ("install", "uninstall") and not a.name:
        p.error(f"{a.action} needs a name")
    return PluginCommand(a.action, a.name, a.force, a.refresh, a.plugins_dir, a.plugin_dir, a.plugin_index_url)


def parse_args(argv: list[str]) -> Config:
    argv, kinds, edits = _dynamic(with_options(argv))
    a = parser().parse_args(argv)
    files, flags = [], {}
    for name in ("append", "sort", "recurse"):
        value = to_bool(getattr(a, name))
        if value is None:  # it was a file name after a bare flag
            files.append(getattr(a, name))
        flags[name] = True if value is None else value
    command, argument = "", ""
    for name in ("print_language", "list_languages", "suggest_plugins"):
        command = name if getattr(a, name) else command
    for name in ("list_maps", "list_kinds"):
        if getattr(a, name) is not None:
            command, argument = name, getattr(a, name)
    early = [e for value in a.langmap for e in langmap(value)]
    return Config(
        files=[*files, *a.files],
        tag_file=a.tag_file,
        excludes=exclude_patterns(a.exclude),
        workers=(os.cpu_count() or 1) if a.max_parallelism else a.workers,
        fields=parse_fields(a.fields),
        extras=parse_extras(a.extras),
        kinds=kinds,
        edits=early + edits,
        force=a.language_force,
        guess=a.guess_language_eagerly,
        plugin_dirs=[*([f"{a.plugins_dir}/**"] if a.plugins_dir else []), *filter(None, a.plugin_dir)],
        user_grammars=a.user_languages_config,
        cached=a.plugin_cache,
        index=a.plugin_index_url,
        command=command,
        argument=argument,
        **flags,
    )
