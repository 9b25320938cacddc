"""Languages, their names and kinds, and the tables that resolution joins with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

# Fixed values: (letter, names, whether on unless asked otherwise) of each language's kinds.
KINDS: dict[str, tuple[tuple[str, tuple[str, ...], bool], ...]] = {
    "rust": (
        ("n", ("module",), True),
        ("s", ("struct",), True),
        ("g", ("enum",), True),
        ("u", ("union",), True),
        ("i", ("trait", "interface"), True),
        ("c", ("impl", "implementation"), True),
        ("f", ("function",), True),
        ("P", ("method", "procedure"), True),
        ("m", ("field",), True),
        ("e", ("enumerator", "variant"), True),
        ("T", ("typedef", "associated_type"), True),
        ("C", ("constant",), True),
        ("v", ("variable", "static"), True),
        ("t", ("type", "alias"), True),
        ("M", ("macro",), True),
    ),
    "go": (
        ("p", ("package",), True),
        ("f", ("function",), True),
        ("c", ("constant",), True),
        ("t", ("type",), True),
        ("v", ("variable",), True),
        ("s", ("struct",), True),
        ("i", ("interface",), True),
        ("m", ("member",), True),
        ("M", ("anonymous",), True),
        ("n", ("method",), True),
        ("P", ("import",), True),
        ("a", ("alias",), True),
    ),
    "c++": (
        ("d", ("macro",), True),
        ("e", ("enumerator",), True),
        ("f", ("function",), True),
        ("g", ("enum",), True),
        ("h", ("header",), True),
        ("m", ("member",), True),
        ("s", ("struct",), True),
        ("t", ("typedef",), True),
        ("u", ("union",), True),
        ("v", ("variable",), True),
        ("c", ("class",), True),
        ("l", ("local",), False),
        ("p", ("prototype",), False),
        ("x", ("externvar",), False),
        ("z", ("parameter",), False),
        ("L", ("label",), False),
        ("D", ("macroparam",), False),
        ("n", ("namespace",), False),
        ("A", ("alias",), False),
        ("N", ("name",), False),
        ("U", ("using",), False),
        ("Z", ("tparam",), False),
        ("M", ("module",), False),
    ),
    "c": (
        ("d", ("macro",), True),
        ("e", ("enumerator",), True),
        ("f", ("function",), True),
        ("g", ("enum",), True),
        ("h", ("header",), True),
        ("m", ("member",), True),
        ("s", ("struct",), True),
        ("t", ("typedef",), True),
        ("u", ("union",), True),
        ("v", ("variable",), True),
        ("l", ("local",), False),
        ("p", ("prototype",), False),
        ("x", ("externvar",), False),
        ("z", ("parameter",), False),
        ("L", ("label",), False),
        ("D", ("macroparam",), False),
    ),
    "javascript": (
        ("f", ("function",), True),
        ("c", ("classes",), True),
        ("m", ("methods",), True),
        ("p", ("properties",), True),
        ("C", ("constants",), True),
        ("v", ("global variables",), True),
        ("g", ("generators",), True),
        ("G", ("getters",), True),
        ("S", ("setters",), True),
        ("M", ("fields",), True),
    ),
    "python": (
        ("c", ("classes",), True),
        ("f", ("function",), True),
        ("m", ("class members",), True),
        ("v", ("variables",), True),
        ("I", ("name referring a module defined in other file",), True),
        ("i", ("module",), True),
        ("Y", ("name referring to a class/variable/function/module defined in other module",), True),
        ("z", ("function parameters",), False),
        ("l", ("local variables",), False),
    ),
    "typescript": (
        ("f", ("function",), True),
        ("c", ("class",), True),
        ("i", ("interface",), True),
        ("g", ("enum",), True),
        ("e", ("enumarator",), True),
        ("m", ("method",), True),
        ("n", ("namespace",), True),
        ("p", ("property",), True),
        ("v", ("global variables",), True),
        ("C", ("constants",), True),
        ("G", ("generators",), True),
        ("a", ("alias",), True),
        ("z", ("function parameter",), False),
        ("l", ("local variable",), False),
    ),
    "java": (
        ("a", ("annotation",), True),
        ("c", ("class",), True),
        ("e", ("enumConstant",), True),
        ("f", ("field",), True),
        ("g", ("enum",), True),
        ("i", ("interface",), True),
        ("m", ("method",), True),
        ("p", ("package",), True),
        ("l", ("local",), False),
    ),
    "kotlin": (
        ("C", ("constant",), True),
        ("T", ("typealias",), True),
        ("c", ("class",), True),
        ("i", ("interface",), True),
        ("m", ("method",), True),
        ("o", ("object",), True),
        ("p", ("package",), True),
        ("v", ("variable",), True),
    ),
}
#: Kinds whose letter stands for another kind's canonical letter.
CANONICAL = {("typescript", "C"): "p", ("typescript", "G"): "g"}

TIERS = ("plugin", "native", "query", "user")


@dataclass(frozen=True)
class Language:
    """One source of a language: its tier, its names and what marks its files."""

    name: str
    tier: str
    extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    interpreters: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    internal: bool = False


# Languages in order of rank inside their tier.
BUILT_IN: tuple[Language, ...] = (
    Language("rust", "native", ("rs",)),
    Language("go", "native", ("go",), aliases=("golang",)),
    Language("c++", "native", ("cc", "cpp", "CPP", "cxx", "c++", "cp", "C", "cppm", "ixx", "ii", "H", "hh", "hpp", "HPP", "hxx", "h++", "tcc"), aliases=("cpp", "cxx", "cplusplus")),
    Language("c", "native", ("c", "h", "i")),
    Language("javascript", "native", ("js", "jsx", "mjs", "cjs"), interpreters=("node", "nodejs"), aliases=("js",)),
    Language("python", "native", ("py", "pyw", "pyi"), ("SConstruct", "SConscript", "wscript"), ("python", "python2", "python3")),
    Language("typescript", "native", ("ts", "tsx"), aliases=("ts",)),
    Language("ruby", "query", ("rb",), ("Rakefile", "Gemfile", "Guardfile", "Vagrantfile", "Podfile", "Berksfile", "Brewfile", "Capfile", "*.gemspec", "*.podspec", "*.rake"), ("ruby",)),
    Language("java", "query", ("java",)),
    Language("ocaml", "query", ("ml",)),
    Language("php", "query", ("php",), interpreters=("php",)),
    Language("elixir", "query", ("ex",)),
    Language("lua", "query", ("lua",), interpreters=("lua",)),
    Language("c#", "query", ("cs",), aliases=("csharp",)),
    Language("shell", "query", ("sh", "bash"), (".bashrc", ".bash_profile", ".bash_logout", ".zshrc", ".zprofile", ".zshenv", ".profile", "PKGBUILD", "*.zsh"), ("sh", "bash", "dash", "zsh", "ksh"), ("sh", "bash")),
    Language("scala", "query", ("scala",), interpreters=("scala",)),
    Language("julia", "query", ("jl",), interpreters=("julia",)),
)
#: Rule languages that plugins or user grammars bring.
PLUGINS: tuple[Language, ...] = (Language("java", "plugin", ("java",)), Language("kotlin", "plugin", ("kt", "kts")))
ECHO = Language("echo", "plugin", ("echo",))
GLEAM = Language("gleam", "user", ("gleam",))
#: Extensions that stay candidates of two languages until a file's content is seen.
SHARED_EXTENSIONS = {"h": ("c", "c++")}


@dataclass
class Kind:
    letter: str
    names: tuple[str, ...]
    default: bool
    canonical: str


def kinds_of(language: str) -> list[Kind]:
    return [Kind(letter, names, on, CANONICAL.get((language, letter), letter)) for letter, names, on in KINDS.get(language, ())]


def kinds_table(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, k.letter, k.names[0], k.default, k.canonical) for lang in KINDS for i, k in enumerate(kinds_of(lang))]
    return spark.createDataFrame(rows, "lang string, ord int, letter string, name string, is_default boolean, canonical string")


@dataclass(frozen=True)
class Edit:
    """One change of the language map: op is add, remove or clear; what is ext, pattern or regex."""

    language: str
    op: str
    what: str = ""
    value: str = ""


@dataclass
class Registry:
    """Who claims which name, in order of rank; all of it is small and fixed by the configuration."""

    languages: list[Language]
    ext: dict[str, list[str]] = field(default_factory=dict)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    regexes: list[tuple[str, str]] = field(default_factory=list)
    interpreters: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    won: dict[tuple[str, str], bool] = field(default_factory=dict)
    forced: str | None = None

    @property
    def known(self) -> dict[str, str]:
        return {lang.name.lower(): lang.name for lang in self.languages}

    def named(self, name: str) -> str | None:
        key = name.strip().lower()
        for k in (key, key.removesuffix("-mode")):
            found = self.known.get(k) or self.aliases.get(k)
            if found:
                return found
        return None


class UnknownLanguage(ValueError):
    pass


def build_registry(languages: list[Language] | None = None, edits: list[Edit] | None = None, force: str = "") -> Registry:
    """Tiers claim extensions from the top; a lower tier keeps its patterns, interpreters and aliases."""
    every = sorted(BUILT_IN if languages is None else languages, key=lambda lang: TIERS.index(lang.tier))
    r = Registry(every)
    claimed: dict[str, str] = {}
    for lang in every:
        mine = [e for e in lang.extensions if claimed.setdefault(e, lang.tier) == lang.tier]
        for e in mine:
            if lang.name not in r.ext.setdefault(e, []):
                r.ext[e].append(lang.name)
        r.won[(lang.tier, lang.name)] = r.won.get((lang.tier, lang.name), False) or bool(mine) or not lang.extensions
        r.patterns += [(p, lang.name) for p in lang.patterns]
        for i in lang.interpreters:
            r.interpreters.setdefault(i.lower(), lang.name)
        for a in lang.aliases:
            r.aliases.setdefault(a.lower(), lang.name)
    for e, pair in SHARED_EXTENSIONS.items():
        if r.ext.get(e) == [pair[0]] and claimed.get(e) == "native" and any(lang.name == pair[1] and lang.tier == "native" for lang in every):
            r.ext[e] = list(pair)
    for edit in edits or []:
        name = r.named(edit.language)
        if name is None:
            raise UnknownLanguage(edit.language)
        _apply(r, name, edit)
    if force and force.lower() != "auto":
        r.forced = r.named(force)
        if r.forced is None:
            raise UnknownLanguage(force)
    return r


def _apply(r: Registry, name: str, edit: Edit) -> None:
    if edit.op == "clear":
        r.ext = {e: [x for x in who if x != name] for e, who in r.ext.items()}
        r.patterns = [p for p in r.patterns if p[1] != name]
        r.regexes = [p for p in r.regexes if p[1] != name]
    elif edit.what == "ext":
        rest = [x for x in r.ext.get(edit.value, []) if x != name]
        r.ext[edit.value] = [name, *rest] if edit.op == "add" else rest
    else:
        table = r.patterns if edit.what == "pattern" else r.regexes
        rest = [p for p in table if p != (edit.value, name)]
        table[:] = [(edit.value, name), *rest] if edit.op == "add" else rest
    r.ext = {e: who for e, who in r.ext.items() if who}


def tables(spark: SparkSession, r: Registry) -> dict[str, DataFrame]:
    """The dimension tables of resolution. Each has as many rows as the configuration has names."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "lang_ext": make([(e, i, n) for e, who in r.ext.items() for i, n in enumerate(who)], "ext string, priority int, lang string"),
        "lang_glob": make([(g, glob_regex(g), i, n) for i, (g, n) in enumerate(r.patterns)], "glob string, rx string, priority int, lang string"),
        "lang_rexpr": make([(x, i, n) for i, (x, n) in enumerate(r.regexes)], "rx string, priority int, lang string"),
        "lang_interp": make([(k, n) for k, n in r.interpreters.items()], "interp string, lang string"),
        "lang_alias": make([(k, n) for k, n in {**r.aliases, **r.known}.items()], "alias string, lang string"),
        "sources": make([(t, n, won, sorted({e for lang in r.languages if (lang.tier, lang.name) == (t, n) for e in lang.extensions})) for (t, n), won in r.won.items()], "kind string, name string, won boolean, extensions array<string>"),
    }


def language_maps(spark: SparkSession, r: Registry) -> DataFrame:
    """lang, extensions (sorted), patterns (in order of rank), one row a language."""
    t = tables(spark, r)
    ext = t["lang_ext"].groupBy("lang").agg(F.array_sort(F.collect_set("ext")).alias("extensions"))
    glob = t["lang_glob"].groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "glob"))), lambda x: x["glob"]).alias("patterns"))
    empty = F.array().cast("array<string>")
    return ext.join(glob, "lang", "full").select("lang", F.coalesce("extensions", empty).alias("extensions"), F.coalesce("patterns", empty).alias("patterns"))


def first_tier_wins(claims: DataFrame) -> DataFrame:
    """(ext, tier_rank, priority, lang) -> the language that the least tier and rank gives an extension."""
    return claims.groupBy("ext").agg(F.min_by("lang", F.struct("tier_rank", "priority")).alias("lang"))
