"""Every operator as a query over the driver's tables, with DuckDB SQL that says the same.

The tables hold no source code, so files are made from their rows by templates; what each
template must give is written beside it and is filled in by SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import modeline
from .functions import text as fx
from .operators import listing, resolve, tags
from .operators.match import definitions, match, node_table
from .operators.extract import errors_only, extract_tags, job_of, register_table_function, tags_only
from .plans.generate import tags_of_files
from .plans.patterns import parse_patterns
from .plans.languages import BUILT_IN, ECHO, GLEAM, PLUGINS, Edit, build_registry, first_tier_wins
from .session import scratch, shared_dir, spread, written
from .sources import plugin_store, plugins, storage
from .sources.files import discover
from .sources.tag_cache import TagCache

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- scalar operators -----------------------------------------------------------------

LINES = r"""(SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM (
  SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS a FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS s FROM documents)))"""
ESCAPED = r"regexp_replace(line, '([\\/^$])', '\\\1', 'g')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fx.split_lines(F.col("text"))).alias("pos", "line"))
    return docs.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query(f"SELECT doc_id, line_no, line FROM {LINES}")
def split_lines(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"SELECT doc_id, line_no, '/^' || {ESCAPED} || '$/;\"' AS address FROM {LINES}")
def address_full(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", fx.full_address(F.col("line")).alias("address"))


CUT = "coalesce(try(decode(encode(e)[1:96])), try(decode(encode(e)[1:95])), try(decode(encode(e)[1:94])), try(decode(encode(e)[1:93])))"
TRUNCATED = f"'/^' || CASE WHEN octet_length(encode(e)) <= 96 THEN e || '$/;\"' ELSE {CUT} || '/;\"' END"


@query(f"SELECT doc_id, line_no, {TRUNCATED} AS address FROM (SELECT doc_id, line_no, {ESCAPED} AS e FROM {LINES})")
def address_truncated(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", fx.truncated_address(F.col("line")).alias("address"))


@query(f"SELECT doc_id, line_no, {TRUNCATED} || chr(9) AS address FROM (SELECT doc_id, line_no, regexp_replace(rtrim(line, ' '), '([\\\\/^$])', '\\\\\\1', 'g') AS e FROM {LINES})")
def address_query(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", fx.query_address(F.col("line")).alias("address"))


@query("SELECT page_id, regexp_extract(url, '[^/]\\.([^./]*)$', 1) AS ext, regexp_extract(url, '[^/\\\\]*$', 0) AS base FROM pages")
def file_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fx.extension(url).alias("ext"), fx.basename(url).alias("base"))


@query("SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '.*\\.html') OR regexp_matches(url, 'item.[0-4]'))")
def exclude_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(~fx.excluded(F.col("url"), ["*.html", "item?[0-4]"])).select("page_id", "url")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*(et|l.)$') AND NOT regexp_matches(p_name, '^.e')")
def glob_match(spark, sf_dir):
    name = F.col("p_name")
    one = fx.glob_match(name, "[a-m]*et") | fx.glob_match(name, "[!n-zA-Z0-9]*l?")
    return table(spark, sf_dir, "part").filter(one & ~fx.glob_match(name, "?e*")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, regexp_matches(p_name, '^.[a-m]') AND p_size % 3 <> 1 AS first, p_size % 3 <> 0 AS wide, regexp_matches(p_name, '^[^ ]*[t-v][^ ]*( .*)?$') AND p_size % 3 = 2 AS last FROM part""")
def glob_bytes(spark, sf_dir):
    """Patterns count in bytes: two for é, which stands behind every third name, and one for a line feed."""
    end = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "é").otherwise("\n")
    name = F.concat("p_name", end)
    first = fx.glob_match(name, "?[a-m]*") & ~fx.glob_match(name, "*[\x80-ÿ]")
    wide = fx.glob_match(F.concat(F.lit("x"), end), "x??") | fx.glob_match(end, "\n")
    last = fx.glob_match(F.concat(F.regexp_extract("p_name", "^[^ ]*", 0), end), "*[t-v]*\n")
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("first"), wide.alias("wide"), last.alias("last"))


@query("""SELECT p_partkey, lpad(printf('%x', list_reduce(list_prepend(CAST(5381 AS BIGINT),
  list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (h * 33 + b) % 4294967296)), 8, '0') AS hash FROM part""")
def filename_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fx.djb2_hex(F.col("p_name")).alias("hash"))


@query("""SELECT p_partkey, format('{:08x}{:08x}', CAST(h // 4294967296 AS BIGINT), CAST(h % 4294967296 AS BIGINT)) AS hash FROM (
  SELECT p_partkey, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM part)""")
def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fx.fnv_hex(F.col("p_name")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def sha256_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.sha256_hex(F.col("text")).alias("hash"))


SHEBANG = "'#!/usr/' || CASE p_size % 3 WHEN 0 THEN 'bin/env -S A=1 ' ELSE 'local/bin/' END || CASE p_size % 2 WHEN 0 THEN 'python3.1' ELSE 'bash' END || CASE p_size % 5 WHEN 0 THEN ' -x' ELSE '' END || chr(10) || p_name"


@query("SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'python3.1' ELSE 'bash' END AS interp, CASE p_size % 2 WHEN 0 THEN 'python' ELSE 'bash' END AS plain, CASE p_size % 2 WHEN 0 THEN 'python' ELSE 'shell' END AS lang FROM part")
def shebang(spark, sf_dir):
    head = table(spark, sf_dir, "part").select("p_partkey", F.expr(SHEBANG.replace("chr(10)", "char(10)")).alias("head"))
    interp = fx.shebang_interpreter(F.col("head"))
    return head.select("p_partkey", interp.alias("interp"), fx.strip_version(interp).alias("plain"), resolve.by_interpreter(F.col("head"), build_registry()).alias("lang"))


FIRST_BYTES = "coalesce(" + ", ".join(f"try(decode(encode(text)[1:{n}]))" for n in (8192, 8191, 8190, 8189)) + ")"


@query("SELECT doc_id, " + " OR ".join(f"contains(head, {quoted(m)})" for m in fx.CPP_MARKS) + f" AS cpp FROM (SELECT doc_id, {FIRST_BYTES} AS head FROM documents)")
def cpp_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.looks_like_cpp(F.col("text")).alias("cpp"))


@query("""SELECT e.event_id, CASE WHEN e.event_id % 3 = 0 THEN 'private' WHEN e.event_id % 3 = 1 THEN 'protected' ELSE 'public' END AS access,
  CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false END AS flag, trim(regexp_replace('  a ' || chr(9) || event_type || chr(10) || ' b ', '\\s+', ' ', 'g')) AS plain FROM events e""")
def small_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("_"), "event_type")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("_"), "event_type")).otherwise(F.concat(F.lit("__"), "event_type", F.lit("__")))
    kind = F.when(F.col("event_id") % 3 == 0, "l").otherwise("v")
    word = F.when(F.col("event_type") == "view", "Yes").when(F.col("event_type") == "click", "OFF").otherwise(F.col("event_type"))
    return e.select("event_id", fx.access_level(name, kind).alias("access"), fx.to_bool(word).alias("flag"), fx.squeeze(F.concat(F.lit("  a \t"), "event_type", F.lit("\n b "))).alias("plain"))


@query("""SELECT s_suppkey, 'sys/' || s_suppkey || '.h' AS include, CASE s_suppkey % 2 WHEN 0 THEN 'operator +=' ELSE 'operator' END AS op,
  CASE s_suppkey % 3 WHEN 0 THEN 'unknown:X' ELSE 'module:M' || s_suppkey || '.X' END AS ref, 'a::b' || s_suppkey AS scope, '*.c, *.h' || s_suppkey AS globs,
  CASE s_suppkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'update available' ELSE 'installed' END AS status,
  'http://x.org/3/p' || s_suppkey AS url, '\\x20a\\\\t' || s_suppkey AS ident FROM supplier""")
def name_functions(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    m = F.col("s_suppkey") % 3
    installed = F.when(m == 1, F.lit("1.9.0-rc.1")).when(m == 2, F.lit("1.10.0"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        fx.include_name(F.concat(F.lit("<sys/"), k, F.lit('.h"'))).alias("include"),
        fx.operator_name(F.when(F.col("s_suppkey") % 2 == 0, "operator+=").otherwise("operator")).alias("op"),
        fx.name_reference(F.when(m == 0, ".").otherwise(F.concat(F.lit("M"), k)), F.lit("X")).alias("ref"),
        fx.scope_path(F.array(F.lit("a"), F.concat(F.lit("b"), k)), "::").alias("scope"),
        fx.ext_globs(F.array(F.lit("c"), F.concat(F.lit("h"), k))).alias("globs"),
        fx.version_status(installed, F.lit("1.10.0")).alias("status"),
        fx.asset_url(F.lit("http://x.org//"), F.lit("3"), F.concat(F.lit("p"), k)).alias("url"),
        fx.escape_identifier(F.concat(F.lit(" a\\t"), k, F.lit("  "))).alias("ident"),
    )


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'ruby' WHEN 2 THEN 'rust' END AS lang FROM part")
def modelines(spark, sf_dir):
    forms = F.when(F.col("p_size") % 4 == 0, F.lit("# vim: set ts=4 ft=python :")).when(F.col("p_size") % 4 == 1, F.lit("-*- mode: Ruby; tab-width: 2 -*-"))
    forms = forms.when(F.col("p_size") % 4 == 2, F.lit("Local Variables:\nmode: rust-mode\nEnd:")).otherwise(F.lit("vimmer: ft=go"))
    found = modeline.modeline_type(F.concat(F.col("p_name"), F.lit("\n"), forms, F.lit("\n")).cast("binary"))
    first = table(spark, sf_dir, "part").filter("p_size % 4 <> 1").withColumn("m", found)
    top = table(spark, sf_dir, "part").filter("p_size % 4 = 1").withColumn("m", modeline.modeline_type(F.concat(forms, F.lit("\n"), F.col("p_name")).cast("binary")))
    return first.unionByName(top).select("p_partkey", resolve.by_name(F.col("m"), build_registry()).alias("lang"))


# --- resolution -----------------------------------------------------------------------

ENDS = ["rs", "go", "C", "h", "py", "H", "jsx", "tsx", "rb", "zip"]
URL_LANG = {"rs": "rust", "go": "go", "C": "c++", "py": "python", "H": "c++", "jsx": "javascript", "tsx": "typescript", "rb": "ruby"}


def named_files(spark, sf_dir) -> DataFrame:
    """A path for each part: by extension, or by a known name; those of ``.h`` files are C++ for even sizes."""
    p = table(spark, sf_dir, "part")
    ends = F.array(*(F.lit(e) for e in ENDS))
    ext = F.element_at(ends, (F.col("p_partkey") % len(ENDS) + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("d/x.gemspec"))).when(F.col("p_partkey") % 13 == 0, F.lit("a/SConstruct")).otherwise(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit("."), ext))
    text = F.when(F.col("p_size") % 2 == 0, F.lit("class A { public: int x; };")).otherwise(F.lit("int x;"))
    return p.select("p_partkey", path.alias("rel_path"), text.cast("binary").alias("content"))


_case = " ".join(f"WHEN {i} THEN " + (quoted(URL_LANG[e]) if e in URL_LANG else "CASE WHEN p_size % 2 = 0 THEN 'c++' ELSE 'c' END" if e == "h" else "NULL") for i, e in enumerate(ENDS))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'ruby' WHEN p_partkey % 13 = 0 THEN 'python' ELSE CASE p_partkey % {len(ENDS)} {_case} END END AS lang FROM part")
def resolve_languages(spark, sf_dir):
    return resolve.resolve(named_files(spark, sf_dir), build_registry()).select("p_partkey", "lang")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 1 WHEN p_partkey % 13 = 0 THEN 1 ELSE CASE p_partkey % {len(ENDS)} WHEN {ENDS.index('h')} THEN 2 WHEN {ENDS.index('zip')} THEN 0 ELSE 1 END END AS n FROM part")
def name_candidates(spark, sf_dir):
    return resolve.candidates(named_files(spark, sf_dir), build_registry()).select("p_partkey", F.size("cands").alias("n"))


@query("SELECT p_partkey, 'go' AS lang FROM part")
def forced_language(spark, sf_dir):
    return resolve.resolve(named_files(spark, sf_dir), build_registry(force="GoLang")).select("p_partkey", "lang")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN CASE WHEN p_partkey % 11 = 0 THEN 'ruby' ELSE 'python' END WHEN p_partkey % 10 = 9 THEN 'lua' WHEN p_partkey % 20 = 0 THEN 'scala' WHEN p_partkey % 10 = 0 THEN 'rust' ELSE 'other' END AS lang FROM part")
def mapped_languages(spark, sf_dir):
    """Edits of the map: an extension, and a regex of the path, which comes before all names."""
    r = build_registry(edits=[Edit("Lua", "add", "ext", "zip"), Edit("scala", "add", "regex", r"src/.*[02468]0\.rs$")])
    got = resolve.resolve(named_files(spark, sf_dir), r)
    plain = F.when((F.col("p_partkey") % 10).isin(0, 9) | (F.col("p_partkey") % 11 == 0) | (F.col("p_partkey") % 13 == 0), F.col("lang")).otherwise("other")
    return got.select("p_partkey", plain.alias("lang"))


TREE = "'d' || s_suppkey % 7 || '/s' || s_suppkey % 3 || '/x' || s_suppkey % 2 || '/f' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.o' ELSE '.py' END"


@query(f"SELECT {TREE} AS rel_path, s_suppkey % 50 AS size FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 4")
def discovered_files(spark, sf_dir):
    """A tree of files, one for each supplier, as executors find it: without objects and without one folder."""
    root = scratch(spark, "tree")

    def make(batches):
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("size").to_pylist()):
                storage.put(f"{root}/{name}", b"x" * size)
            yield batch

    rows = table(spark, sf_dir, "supplier").select(F.expr(TREE).alias("name"), (F.col("s_suppkey") % 50).alias("size"))
    rows.mapInArrow(make, rows.schema).write.format("noop").mode("overwrite").save()
    return discover(spark, [root], ["*.o", "/d4/"], base=root, ahead=200)[0].select("rel_path", "size")


# --- listings -------------------------------------------------------------------------


LISTED = "SELECT CASE p_partkey % 10 WHEN 0 THEN 'rs' WHEN 1 THEN 'go' WHEN 2 THEN 'C' WHEN 3 THEN 'h' WHEN 4 THEN 'py' WHEN 5 THEN 'H' WHEN 6 THEN 'jsx' WHEN 7 THEN 'tsx' WHEN 8 THEN 'rb' END AS ext FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0"


@query(f"""SELECT lang, items, count(*) AS files FROM ({LISTED}) JOIN (VALUES
  ('rust', '.rs', ['rs']),
  ('go', '.go', ['go']),
  ('c++', '.C .CPP .H .HPP .c++ .cc .cp .cpp .cppm .cxx .h .h++ .hh .hpp .hxx .ii .ixx .tcc', ['C', 'h', 'H']),
  ('c', '.c .h .i', ['h']),
  ('python', '.py .pyi .pyw SConstruct SConscript wscript', ['py']),
  ('javascript', '.cjs .js .jsx .mjs', ['jsx']),
  ('typescript', '.ts .tsx', ['tsx']),
  ('ruby', '.rb Rakefile Gemfile Guardfile Vagrantfile Podfile Berksfile Brewfile Capfile *.gemspec *.podspec *.rake', ['rb'])
  ) t(lang, items, exts) ON list_contains(exts, ext) GROUP BY lang, items""")
def list_maps(spark, sf_dir):
    """The map of each language that claims the extension of some file, and how many files that are."""
    return listing.maps_of_files(named_files(spark, sf_dir), build_registry())


@query("""SELECT name, label, count(*) AS files FROM (SELECT ['java', 'kt', 'py', 'rb', 'zip'][s_suppkey % 5 + 1] AS ext FROM supplier) JOIN (VALUES
  ('java', '[plugin]', 'java'), ('java', '[native, overridden]', 'java'), ('kotlin', '[plugin]', 'kt'), ('python', '', 'py'), ('ruby', '', 'rb')) t(name, label, ext) USING (ext) GROUP BY name, label""")
def list_languages(spark, sf_dir):
    """Every source of a language for the files of a tree: those that won and those that a higher tier overrules."""
    ends = F.array(*(F.lit(e) for e in ("java", "kt", "py", "rb", "zip")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a.b/f."), F.element_at(ends, (F.col("s_suppkey") % 5 + 1).cast("int"))).alias("rel_path"))
    return listing.languages_of_files(files, build_registry([*PLUGINS, *BUILT_IN]))


@query("""SELECT lang, letter, name, is_default, canonical, count(*) AS tags
  FROM (SELECT ['python', 'rust', 'typescript', 'java'][l_orderkey % 4 + 1] AS lang, ['c', 'f', 'm', 'l', 'C'][l_linenumber % 5 + 1] AS letter FROM lineitem) LEFT JOIN (VALUES
  ('python', 'c', 'classes', true, 'c'), ('python', 'f', 'function', true, 'f'), ('python', 'm', 'class members', true, 'm'), ('python', 'l', 'local variables', false, 'l'),
  ('rust', 'c', 'impl', true, 'c'), ('rust', 'f', 'function', true, 'f'), ('rust', 'm', 'field', true, 'm'), ('rust', 'C', 'constant', true, 'C'),
  ('typescript', 'c', 'class', true, 'c'), ('typescript', 'f', 'function', true, 'f'), ('typescript', 'm', 'method', true, 'm'), ('typescript', 'l', 'local variable', false, 'l'),
  ('typescript', 'C', 'constants', true, 'p'),
  ('java', 'c', 'class', true, 'c'), ('java', 'f', 'field', true, 'f'), ('java', 'm', 'method', true, 'm'), ('java', 'l', 'local', false, 'l')
  ) t(lang, letter, name, is_default, canonical) USING (lang, letter) GROUP BY ALL""")
def list_kinds(spark, sf_dir):
    """Tags counted by kind, with the kind's name, where its language has one of that letter."""
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n + 1).cast("int"))
    made = table(spark, sf_dir, "lineitem").select(
        pick(("python", "rust", "typescript", "java"), F.col("l_orderkey") % 4).alias("lang"), pick(("c", "f", "m", "l", "C"), F.col("l_linenumber") % 5).alias("letter")
    )
    return listing.kinds_of_tags(made)


@query("SELECT DISTINCT lower(regexp_extract(url, '[^/]\\.([^./]*)$', 1)) AS ext FROM pages WHERE regexp_extract(url, '[^/]\\.([^./]*)$', 1) <> ''")
def extensions_in_tree(spark, sf_dir):
    return listing.extensions_in(table(spark, sf_dir, "pages"), "url")


# --- plugins --------------------------------------------------------------------------


def _index(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    return s.select(F.concat(F.lit("p"), k).alias("name"), F.lit("1.2.0").alias("version"), F.array(F.concat(F.lit("E"), k), F.lit("html")).alias("extensions"), "s_suppkey")


def _installed(spark, sf_dir) -> DataFrame:
    i = _index(spark, sf_dir).filter("s_suppkey % 3 = 0")
    return i.select("name", F.when(F.col("s_suppkey") % 2 == 0, "1.1.9").otherwise("1.2.0").alias("version"))


@query("SELECT 'p' || s_suppkey AS name, '1.2.0' AS version, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '1.1.9' ELSE '1.2.0' END END AS installed_version, CASE WHEN s_suppkey % 3 <> 0 THEN 'available' WHEN s_suppkey % 2 = 0 THEN 'update available' ELSE 'installed' END AS status FROM supplier")
def plugins_available(spark, sf_dir):
    return plugins.available(_index(spark, sf_dir), _installed(spark, sf_dir))


@query("SELECT 'p' || s_suppkey AS name, '1.1.9' AS installed_version, '1.2.0' AS version FROM supplier WHERE s_suppkey % 6 = 0")
def plugins_to_update(spark, sf_dir):
    return plugins.updates(_index(spark, sf_dir), _installed(spark, sf_dir))


@query("SELECT count(*) AS updated FROM supplier WHERE s_suppkey % 6 = 0")
def updates_counted(spark, sf_dir):
    """How many plugins an update would replace."""
    return plugins.updates(_index(spark, sf_dir), _installed(spark, sf_dir)).agg(F.count("*").alias("updated"))


@query("SELECT CAST(greatest(4, max(length(p_name))) AS INTEGER) AS p_name, CAST(greatest(25, max(length(CAST(p_partkey AS VARCHAR)))) AS INTEGER) AS p_partkey FROM part")
def table_widths(spark, sf_dir):
    """Widths of the columns of a printed table."""
    return plugin_store.widths(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["NAME", "A HEADER LONGER THAN KEYS"])


@query("""SELECT p_partkey, 'a\\|' || replace(p_name, ' ', '\\|') AS cell, '\\"' || replace(p_name, ' ', '\\\\') || '\\"' AS text FROM part""")
def escaped_texts(spark, sf_dir):
    """Texts for Markdown cells and JSON strings."""
    p = table(spark, sf_dir, "part")
    bars = F.concat(F.lit("a|"), F.replace("p_name", F.lit(" "), F.lit("|")))
    marks = F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit("\\")), F.lit('"'))
    return p.select("p_partkey", fx.markdown_cell(bars).alias("cell"), fx.json_escaped(marks).alias("text"))


def _suggested(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("ext")).union(spark.createDataFrame([("HTML",), ("zzz",), ("e1",)], "ext string"))
    return plugins.suggest(_index(spark, sf_dir).drop("s_suppkey"), _installed(spark, sf_dir), found, spark.createDataFrame([("html",), ("e4",)], "ext string"))


@query("""SELECT 'p' || s_suppkey AS name, CASE WHEN s_suppkey <= 24 THEN '*.e' || s_suppkey || ', ' ELSE '' END || '*.html' AS globs,
  CASE WHEN s_suppkey = 4 OR s_suppkey > 24 THEN 'native' ELSE 'partly native' END AS label FROM supplier WHERE s_suppkey % 3 <> 0""")
def plugins_suggested(spark, sf_dir):
    return _suggested(spark, sf_dir)[0]


@query("SELECT ext FROM (SELECT 'e' || n_nationkey AS ext FROM nation UNION SELECT 'zzz') WHERE ext NOT IN (SELECT 'e' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) AND ext <> 'e4'")
def extensions_uncovered(spark, sf_dir):
    return _suggested(spark, sf_dir)[1]


@query("SELECT 'x' || (s_suppkey % 7) AS ext, arg_max('p' || s_suppkey, s_suppkey) AS name, arg_max('l' || s_suppkey, s_suppkey) AS language FROM supplier GROUP BY s_suppkey % 7")
def extension_owners(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    m = table(spark, sf_dir, "supplier").select(F.array(F.concat(F.lit("x"), (F.col("s_suppkey") % 7).cast("string"))).alias("extensions"), F.concat(F.lit("p"), k).alias("name"), F.concat(F.lit("l"), k).alias("language"), F.col("s_suppkey").alias("scan_ord"))
    return plugins.extension_owners(m)


@query("SELECT 'x' || (s_suppkey % 7) AS ext, arg_min('l' || s_suppkey, (s_nationkey % 4) * 1000000 + s_suppkey) AS lang FROM supplier GROUP BY s_suppkey % 7")
def first_tier(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return first_tier_wins(s.select(F.concat(F.lit("x"), (F.col("s_suppkey") % 7).cast("string")).alias("ext"), (F.col("s_nationkey") % 4).alias("tier_rank"), F.col("s_suppkey").alias("priority"), F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("lang")))


@query("SELECT n_regionkey, string_agg('.' || n_nationkey, ' ' ORDER BY '.' || n_nationkey) AS exts FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY n_regionkey")
def plugin_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    m = n.select(F.col("n_regionkey").cast("string").alias("path"), F.col("n_regionkey").cast("string").alias("language"), F.lit("n").alias("name"), F.lit("1").alias("version"), F.array(F.concat(F.lit("."), F.col("n_nationkey").cast("string"))).alias("extensions"), (F.col("n_nationkey") % 5 == 0).alias("internal"))
    return plugins.plugin_groups(m).select(F.col("language").cast("int").alias("n_regionkey"), F.array_join("extensions", " ").alias("exts"))


@query("SELECT '9 8 7 6 5 4 3 2 1 0' AS abis, 9 AS latest")
def merged_abis(spark, sf_dir):
    lists = table(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey") % 10, F.col("n_nationkey") % 3).alias("abis"))
    return plugins.merged_abis(lists).select(F.array_join("abis", " ").alias("abis"), "latest")


# --- tags as rows ---------------------------------------------------------------------


def made_tags(spark, sf_dir) -> DataFrame:
    """A tag for each order line: with kind or not, with a module or not."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber")
    part = lambda a, b: F.struct(F.lit(a).alias("key"), b.alias("value"))
    text = F.col("l_partkey").cast("string")
    fields = F.when(k % 4 == 0, F.array(part("module", text))).when(k % 4 == 1, F.array(part("line", text), part("struct", F.col("l_returnflag")), part("module", text))).when(k % 4 == 2, F.array(part("kind", F.lit("v")), part("typeref", text)))
    return li.select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("name"), F.concat(F.lit("f"), k.cast("string"), F.lit(".rs")).alias("file_name"), F.concat(F.lit("/^"), text, F.lit('$/;"')).alias("address"), F.when(k % 3 != 0, F.lit("v")).alias("kind"), fields.alias("fields"))


RENDERED = """SELECT 'n' || l_orderkey || chr(9) || 'f' || l_linenumber || '.rs' || chr(9) || '/^' || l_partkey || '$/;"'
  || CASE WHEN l_linenumber % 3 <> 0 AND l_linenumber % 4 <> 2 THEN chr(9) || 'v' ELSE '' END
  || CASE l_linenumber % 4 WHEN 0 THEN chr(9) || 'module:' || l_partkey WHEN 1 THEN chr(9) || 'line:' || l_partkey || chr(9) || 'struct:' || l_partkey || '::' || l_returnflag
     WHEN 2 THEN chr(9) || 'kind:v' || chr(9) || 'typeref:' || l_partkey ELSE '' END AS value FROM lineitem"""


@query(RENDERED)
def render_tags(spark, sf_dir):
    return tags.render(made_tags(spark, sf_dir)).select("value")


@query("""SELECT 'n' || l_orderkey AS name, 'f' || l_linenumber || '.rs' AS file_name, '/^' || l_partkey || '$/;"' || chr(9) AS address,
  CASE WHEN l_linenumber % 4 = 2 OR l_linenumber % 3 <> 0 THEN 'v' END AS kind,
  CASE l_linenumber % 4 WHEN 0 THEN 'module=' || l_partkey WHEN 1 THEN 'line=' || l_partkey || ';struct=' || l_partkey || '::' || l_returnflag WHEN 2 THEN 'typeref=' || l_partkey END AS fields
  FROM lineitem""")
def parse_tag_lines(spark, sf_dir):
    back = tags.parse_lines(tags.render(made_tags(spark, sf_dir)).select("value").union(spark.createDataFrame([("!_TAG_X\ta\tb",), ("a\tb",)], "value string")))
    return back.withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["value"])), ";"))


@query(f"SELECT value FROM ({RENDERED}) UNION ALL SELECT value FROM ({RENDERED}) WHERE contains(value, 'f1.rs')")
def append_tags(spark, sf_dir):
    t = made_tags(spark, sf_dir)
    return tags.render(tags.append(t, t.filter("file_name = 'f1.rs'"))).select("value")


@query(f"""SELECT CAST(row_number() OVER (ORDER BY name, file_name, address, kind NULLS FIRST, fields NULLS FIRST) AS BIGINT) AS rank, name, address FROM (
  SELECT 'n' || l_orderkey AS name, 'f' || l_linenumber || '.rs' AS file_name, '/^' || l_partkey || '$/;"' AS address, l_returnflag AS kind, l_shipdate AS fields FROM lineitem)""")
def total_sort(spark, sf_dir):
    """The order itself, as a rank."""
    return tags.ranked(made_tags(spark, sf_dir)).select("rank", "name", "address")


@query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0")
def kept_kinds(spark, sf_dir):
    return tags.drop_placeholders(tags.keep_kinds(made_tags(spark, sf_dir), ["v"])).agg(F.count("*").alias("n"))


@query("SELECT l_linenumber % 4 AS m, CASE l_linenumber % 4 WHEN 0 THEN 'module,end' WHEN 1 THEN 'line,module,end' WHEN 2 THEN 'kind,end' ELSE 'end' END AS keys, count(*) AS n FROM lineitem GROUP BY 1, 2")
def field_projection(spark, sf_dir):
    t = made_tags(spark, sf_dir).withColumn("m", F.regexp_extract("file_name", r"(\d+)", 1).cast("int") % 4)
    picked = tags.put_field(tags.pick_fields(F.col("fields"), ["module", "line", "kind"]), "end", F.lit("9"))
    return t.withColumn("keys", F.array_join(F.transform(picked, lambda f: f["key"]), ",")).groupBy("m", "keys").agg(F.count("*").alias("n"))


@query("SELECT true AS valid")
def tags_file_is_valid(spark, sf_dir):
    head = spark.createDataFrame([("",), (tags.header(True),)], "value string")
    return tags.valid_tags_file(head.coalesce(1).union(tags.render(made_tags(spark, sf_dir)).select("value")))


# --- extraction -----------------------------------------------------------------------

#: language: (path, source text, lines expected). {k} is a part's key, {a} and {b} the words of its name.
SOURCES: dict[str, tuple[str, str, list[str]]] = {
    "python": (
        "parts/p{k}.py",
        "class P{k}:\n    def {a}_{b}(self, size):\n        local = size\n        return local\n\nTOTAL_{k} = 1\n",
        ['P{k}\t/^class P{k}:$/;"\tc', '{a}_{b}\t/^    def {a}_{b}(self, size):$/;"\tm\tclass:P{k}', 'TOTAL_{k}\t/^TOTAL_{k} = 1$/;"\tv'],
    ),
    "rust": (
        "parts/p{k}.rs",
        "mod m{k} {\n    pub struct {a} {\n        pub {b}: u32,\n    }\n    impl {a} {\n        fn get(&self) -> u32 { self.{b} }\n    }\n}\n",
        ['m{k}\t/^mod m{k} {$/;"\tn', '{a}\t/^    pub struct {a} {$/;"\ts\tmodule:m{k}', '{b}\t/^        pub {b}: u32,$/;"\tm\tstruct:m{k}::{a}', '{a}\t/^    impl {a} {$/;"\tc\tmodule:m{k}', 'get\t/^        fn get(&self) -> u32 { self.{b} }$/;"\tP\timplementation:m{k}::{a}'],
    ),
    "go": (
        "parts/p{k}.go",
        "package p{k}\n\ntype {a} struct {\n{b} int\n}\n\nfunc ({b} {a}) Size() int {\nreturn 1\n}\n",
        ['p{k}\t/^package p{k}$/;"\tp', '{a}\t/^type {a} struct {$/;"\ts\tpackage:p{k}', '{b}\t/^{b} int$/;"\tm\tstruct:p{k}.{a}\ttyperef:typename:int', 'Size\t/^func ({b} {a}) Size() int {$/;"\tf\tstruct:p{k}.{a}\ttyperef:typename:int'],
    ),
    "c": (
        "parts/p{k}.c",
        "#define K{k} {k}\nstruct {a} {\n  int {b};\n};\nint f{k}(int x)\n{\n  return x;\n}\n",
        ['K{k}\t/^#define K{k} {k}$/;"\td', '{a}\t/^struct {a} {$/;"\ts', '{b}\t/^  int {b};$/;"\tm\tstruct:{a}\ttyperef:typename:int', 'f{k}\t/^int f{k}(int x)$/;"\tf\ttyperef:typename:int'],
    ),
    "c++": (
        "parts/p{k}.cpp",
        "class {a} {\npublic:\n  int {b};\n};\nint {a}::g{k}() { return 1; }\nenum E{k} { A{k} };\n",
        ['{a}\t/^class {a} {$/;"\tc', '{b}\t/^  int {b};$/;"\tm\tclass:{a}\ttyperef:typename:int', 'g{k}\t/^int {a}::g{k}() { return 1; }$/;"\tf\ttyperef:typename:int\tclass:{a}', 'E{k}\t/^enum E{k} { A{k} };$/;"\tg', 'A{k}\t/^enum E{k} { A{k} };$/;"\te\tenum:E{k}'],
    ),
    "javascript": (
        "parts/p{k}.js",
        "class {a} {\n  {b}(x) {\n  }\n}\nconst c{k} = 1;\nfunction f{k}() {}\n",
        ['{a}\t/^class {a} {$/;"\tc', '{b}\t/^  {b}(x) {$/;"\tm\tclass:{a}', 'c{k}\t/^const c{k} = 1;$/;"\tC', 'f{k}\t/^function f{k}() {}$/;"\tf'],
    ),
    "typescript": (
        "parts/p{k}.ts",
        "interface {a} {\n  {b}: number;\n}\nenum E{k} { V{k} }\ntype T{k} = string;\n",
        ['{a}\t/^interface {a} {$/;"\ti', '{b}\t/^  {b}: number;$/;"\tp\tinterface:{a}', 'E{k}\t/^enum E{k} { V{k} }$/;"\tg', 'V{k}\t/^enum E{k} { V{k} }$/;"\te\tenum:E{k}', 'T{k}\t/^type T{k} = string;$/;"\ta'],
    ),
    "java": (
        "parts/P{k}.java",
        "package q{k};\n\npublic class {a} {\n  private int {b};\n  public int get() { return {b}; }\n}\n",
        ['q{k}\t/^package q{k};$/;"\tp', '{a}\t/^public class {a} {$/;"\tc', '{b}\t/^  private int {b};$/;"\tf\tclass:{a}\tfile:', 'get\t/^  public int get() { return {b}; }$/;"\tm\tclass:{a}'],
    ),
    "kotlin": (
        "parts/p{k}.kt",
        "package q{k}\n\nclass {a}(val {b}: Int) {\n    fun get() = {b}\n}\n",
        ['q{k}\t/^package q{k}$/;"\tp', '{a}\t/^class {a}(val {b}: Int) {$/;"\tc\tpackage:q{k}', '{b}\t/^class {a}(val {b}: Int) {$/;"\tC\tclass:q{k}.{a}', 'get\t/^    fun get() = {b}$/;"\tm\tclass:q{k}.{a}'],
    ),
    "ruby": ("parts/p{k}.rb", "module M{k}\n  def {a}_{b}\n  end\nend\n", ['M{k}\t/^module M{k}$/;"\t', '{a}_{b}\t/^  def {a}_{b}$/;"\t']),
    "shell": ("parts/p{k}.sh", "{a}_{k}() {\n  echo {b}\n}\n", ['{a}_{k}\t/^{a}_{k}() {$/;"\t']),
    "scala": ("parts/p{k}.scala", "object O{k} {\n  def {a} = 1\n}\n", ['O{k}\t/^object O{k} {$/;"\t', '{a}\t/^  def {a} = 1$/;"\t']),
    "julia": ("parts/p{k}.jl", "struct S{k}\nend\n\nfunction {a}(x)\nend\n", ['S{k}\t/^struct S{k}$/;"\t', '{a}\t/^function {a}(x)$/;"\t']),
    "c#": ("parts/p{k}.cs", "namespace N{k} {\n  class {a} {\n  }\n}\n", ['N{k}\t/^namespace N{k} {$/;"\t', '{a}\t/^  class {a} {$/;"\t']),
    "lua": ("parts/p{k}.lua", "function {a}_{k}(x)\nend\n", ['{a}_{k}\t/^function {a}_{k}(x)$/;"\t']),
    "php": ("parts/p{k}.php", "<?php\nclass C{k} {\n  function {a}() {}\n}\n", ['C{k}\t/^class C{k} {$/;"\t', '{a}\t/^  function {a}() {}$/;"\t']),
    "elixir": ("parts/p{k}.ex", "defmodule M{k} do\n  def {a}(x) do\n  end\nend\n", ['M{k}\t/^defmodule M{k} do$/;"\t', '{a}\t/^  def {a}(x) do$/;"\t']),
    "ocaml": ("parts/p{k}.ml", "let {a}_{k} x = x\n", ['{a}_{k}\t/^let {a}_{k} x = x$/;"\t']),
    "gleam": ("parts/p{k}.gleam", "pub fn {a}_{k}(x) {\n  x\n}\n", ['{a}_{k}\t/^pub fn {a}_{k}(x) {$/;"\t']),
    "echo": ("parts/p{k}.echo", "{a} {b} {k}\n", ['echo_tag\t/^{a} {b} {k}$/;"\tf']),
}


def _fill(text: str) -> F.Column:
    words = F.split("p_name", " ")
    out = F.lit(text)
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{a}", words[0]), ("{b}", words[1])):
        out = F.replace(out, F.lit(mark), value)
    return out


def source_files(spark: SparkSession, sf_dir: str, languages: list[str]) -> DataFrame:
    """A file of each language for each part."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", len(languages))
    made = [F.struct(_fill(SOURCES[lang][0]).alias("rel_path"), _fill(SOURCES[lang][1]).cast("binary").alias("content")) for lang in languages]
    return p.select(F.col("p_partkey").alias("file_ord"), F.explode(F.array(*made)).alias("f")).select("file_ord", "f.rel_path", "f.content")


def _sql_text(text: str) -> str:
    return " || ".join(quoted(t) if t != "\t" else "chr(9)" for t in [x for part in text.split("\t") for x in (part, "\t")][:-1])


def _expected(languages: list[str]) -> str:
    rows = []
    for lang in languages:
        path, _, want = SOURCES[lang]
        for line in want:
            name, rest = line.split("\t", 1)
            rows.append(f"({_sql_text(name + chr(9) + path + chr(9) + rest)})")
    value = "t.v"
    for mark, sql in (("{k}", "CAST(p_partkey AS VARCHAR)"), ("{a}", "split_part(p_name, ' ', 1)"), ("{b}", "split_part(p_name, ' ', 2)")):
        value = f"replace({value}, '{mark}', {sql})"
    return f"SELECT {value} AS value FROM part CROSS JOIN (VALUES {', '.join(rows)}) t(v)"


def _extracted(spark: SparkSession, sf_dir: str, languages: list[str]) -> DataFrame:
    registry = build_registry([*PLUGINS, ECHO, *BUILT_IN, GLEAM])
    # a range sort runs its child twice: what Python made is written first
    rows = written(tags_of_files(source_files(spark, sf_dir, languages), Config(), registry), "extracted")
    return tags.render(tags.sort_tags(tags_only(rows))).select("value")


for _lang in SOURCES:
    query(_expected([_lang]), "extract_" + {"c++": "cpp", "c#": "csharp"}.get(_lang, _lang))(lambda spark, sf_dir, lang=_lang: _extracted(spark, sf_dir, [lang]))


@query(_expected(list(SOURCES)))
def generate_tags(spark, sf_dir):
    """The flagship: a tree of files in every language, resolved, extracted, sorted and rendered."""
    return _extracted(spark, sf_dir, list(SOURCES))


@query("SELECT 'parts/p' || p_partkey || '.py' AS file_name FROM part WHERE p_partkey % 3 = 0")
def unreadable_files(spark, sf_dir):
    """Files that are not UTF-8 are reported, and stop nothing."""
    files = source_files(spark, sf_dir, ["python"])
    broken = files.withColumn("content", F.when(F.col("file_ord") % 3 == 0, F.unhex(F.lit("FF00FE"))).otherwise(F.col("content"))).withColumn("lang", F.lit("python"))
    return errors_only(extract_tags(broken, job_of(Config()))).select("file_name")


#: A module whose lines say what it does: a name is a tag.
ODD_MODULE = """
import os, re

def extract(source, options):
    print("nobody reads this")
    for row, line in enumerate(source.lines):
        word, _, rest = line.partition(" ")
        if word == "die":
            os._exit(3)
        if word == "open":
            open("/etc/hostname")
        if word == "fill":
            "x" * (1 << 40)
        if word == "wrong":
            yield Tag(7, row)
        yield Tag(re.sub("[^a-z]", "_", rest), row, "d", [("word", word)])
"""


@query("""SELECT 'p' || p_partkey || '.odd' AS file_name, CASE WHEN p_partkey % 97 > 4 OR p_partkey % 97 = 3 THEN regexp_replace(p_name, '[^a-z]', '_', 'g') END AS name,
  CASE p_partkey % 97 WHEN 0 THEN 'its process ended' WHEN 1 THEN 'PermissionError' WHEN 2 THEN 'MemoryError' WHEN 4 THEN 'no tag' END AS error FROM part""")
def isolated_plugins(spark, sf_dir):
    """A plugin's module that dies, opens files, fills the memory or sends nonsense fails for that file only."""
    word = F.element_at(F.array(*(F.lit(w) for w in ("die", "open", "fill", "define", "wrong"))), (F.least(F.col("p_partkey") % 97, F.lit(3)) + 1).cast("int"))
    word = F.when(F.col("p_partkey") % 97 == 4, "wrong").otherwise(word)
    # a request, and a new process for each that died, take as long as ten files or more of other languages
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 10)
    files = part.select(F.col("p_partkey").alias("file_ord"), F.concat(F.lit("p"), "p_partkey", F.lit(".odd")).alias("rel_path"), F.lit("odd").alias("lang"), F.concat(word, F.lit(" "), "p_name").cast("binary").alias("content"))
    rows = extract_tags(files, replace(job_of(Config()), modules={"odd": ODD_MODULE}))
    return rows.select("file_name", "name", F.regexp_extract(F.regexp_replace("error", "^PluginFailed: ", ""), "^[^:]*", 0).alias("error"))


@query("""SELECT 'parts/p' || p_partkey || '.py' AS file_name, unnest(['P' || p_partkey, replace(p_name, ' ', '_'), 'TOTAL_' || p_partkey]) AS name, unnest(['c', 'm', 'v']) AS kind,
  unnest([NULL, 'P' || p_partkey, NULL]) AS class, unnest(['1', '2', '6']) AS line FROM part WHERE p_name NOT LIKE '% % %'""")
def tags_by_sql(spark, sf_dir):
    """The table function in SQL, over a table of files; its columns follow the fields asked for."""
    name = register_table_function(spark, job_of(Config()))
    view = f"files_{uuid.uuid4().hex[:8]}"
    source_files(spark, sf_dir, ["python"]).withColumn("lang", F.lit("python")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT file_name, name, kind, class, line FROM {name}(TABLE(SELECT rel_path, lang, content FROM {view}) PARTITION BY (rel_path), 'class,line')")


# --- user queries ---------------------------------------------------------------------

# language -> source and patterns, each with its captures as (match, capture, text); {odd:x} is x for odd keys only
TREES: dict[str, tuple[str, list[tuple[str, list[str]]]]] = {
    "kotlin": (
        "class {a}(val {b}: Int) {\n  fun get{k}(x: Int) = {b}\n  val y = \"{a}\"\n}\nfun {a}() { fun in{k}() { } }\n",
        [
            ("(function_declaration (simple_identifier) @name) @definition.function", ["get{k}", "{a}", "in{k}"]),
            ("(class_declaration body: (class_body (function_declaration name: (_) @method)))", ["get{k}"]),
            ('((function_declaration name: (_) @f) (#match? @f "^in[0-9]*[13579]$"))', ["odd:in{k}"]),
            ("[(property_declaration name: (_) @p) (string_literal) @p]", ["{b}", "y", '"{a}"']),
        ],
    ),
    "go": (
        "func (r *{a}) Do{k}(n int) error {\n}\nfunc {b}(m int) { }\ntype {a} struct {\n}\n",
        [
            ("(method_declaration name: (field_identifier) @name) @definition.method", ["Do{k}"]),
            ("[(method_declaration name: (_) @any) (type_declaration name: (_) @any)]", ["Do{k}", "{a}"]),
            ("(_ parameters: (parameter_list . (identifier) @first))", ["n", "m"]),
        ],
    ),
    "python": (
        "class C{k}(Base):\n    def {a}_{k}(self):\n        return {b}\n\n    x = {k}\n\n\ndef {b}(y): pass\n",
        [
            ("(class_definition body: (block (function_definition name: (identifier) @method)))", ["{a}_{k}"]),
            ("(_ parameters: (parameters (identifier) @last .))", ["Base", "self", "y"]),
            ('(source (function_definition name: (_) @top))', ["{b}"]),
        ],
    ),
    "rust": (
        "pub fn {a}(x: u8) -> u8 { {k} }\nimpl T{k} { fn {b}(&self) {} }\nstruct S{k};\n",
        [
            ("(impl_item name: (_) @owner body: (declaration_list (function_item name: (_) @method)))", ["T{k}", "{b}"]),
            ("(_ name: (_) @name !body)", ["S{k}"]),
            ("(function_item body: (block (integer_literal) @n))", ["{k}"]),
        ],
    ),
    "java": (
        "class {a} {\n  int get{k}(int n) { if (n > 0) { return {b}(n); } }\n}\n",
        [
            ("(class_declaration name: (_) @c body: (class_body (method_declaration name: (_) @m)))", ["{a}", "get{k}"]),
            ('((method_declaration name: (_) @m) (#any-of? @m "get1" "get3" "get5"))', ["few:get{k}"]),
        ],
    ),
}


def _tree_rows() -> str:
    """SQL of (lang, pattern, text) for each part; the marks say which keys a row holds for."""
    rows = [(lang, number, text) for lang, (_, patterns) in TREES.items() for number, (_, found) in enumerate(patterns) for text in found]
    values = ", ".join(f"({quoted(lang)}, {number}, {quoted(text.split(':', 1)[-1])}, {quoted(text.split(':', 1)[0] if ':' in text else '')})" for lang, number, text in rows)
    text = "t.text"
    for mark, sql in (("{k}", "CAST(p_partkey AS VARCHAR)"), ("{a}", "split_part(p_name, ' ', 1)"), ("{b}", "split_part(p_name, ' ', 2)")):
        text = f"replace({text}, '{mark}', {sql})"
    held = "t.held = '' OR t.held = 'odd' AND p_partkey % 2 = 1 OR t.held = 'few' AND p_partkey IN (1, 3, 5)"
    return f"SELECT p_partkey, lang, CAST(pattern AS INTEGER) AS pattern, {text} AS text FROM part CROSS JOIN (VALUES {values}) t(lang, pattern, text, held) WHERE {held}"


def _tree_nodes(spark: SparkSession, sf_dir: str, langs: list[str]) -> DataFrame:
    """Nodes of a source of each language for each part."""
    made = F.array(*(F.struct(F.lit(lang).alias("lang"), _fill(TREES[lang][0]).cast("binary").alias("content"), F.lit(i).alias("i")) for i, lang in enumerate(TREES) if lang in langs))
    files = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", len(langs)).select("p_partkey", F.explode(made).alias("f"))
    return written(node_table(files.select((F.col("p_partkey") * len(TREES) + F.col("f.i")).alias("file_ord"), "f.lang", "f.content")), "nodes")


@query(_tree_rows())
def tree_patterns(spark, sf_dir):
    """Patterns of user queries over a source of each of five languages for each part: what every capture but the definition's own names."""
    out = None
    for lang, (_, patterns) in TREES.items():
        found = match(_tree_nodes(spark, sf_dir, [lang]), parse_patterns(" ".join(p for p, _ in patterns)))
        named = found.select((F.col("file") / len(TREES)).cast("long").alias("p_partkey"), F.lit(lang).alias("lang"), "pattern", F.explode("captures").alias("c")).filter("c.name not like 'definition%'")
        named = named.select("p_partkey", "lang", "pattern", "c.text")
        out = named if out is None else out.unionByName(named)
    return out


@query("SELECT p_partkey, unnest(['get' || p_partkey, split_part(p_name, ' ', 1), 'in' || p_partkey]) AS name, unnest([1, 4, 4]) AS row FROM part")
def tree_definitions(spark, sf_dir):
    """What a query file defines, references left out, and on which row."""
    patterns = parse_patterns("(function_declaration (simple_identifier) @name) @definition.function (property_declaration name: (_) @name) @reference.property")
    nodes = _tree_nodes(spark, sf_dir, ["kotlin"])
    return definitions(nodes, patterns).select((F.col("file") / len(TREES)).cast("long").alias("p_partkey"), "name", "row")


@query("""SELECT name, file_name, address, p_partkey % 100 = 0 OR p_partkey % 1000 = 7 AS fresh FROM (
  SELECT p_partkey, 'parts/p' || p_partkey || '.lua' AS file_name, unnest(CASE WHEN p_partkey % 100 = 0 THEN ['new', 'f' || p_partkey] ELSE ['f' || p_partkey] END) AS name,
    unnest(CASE WHEN p_partkey % 100 = 0 THEN ['/^function new() end$/;"' || chr(9), '/^function f' || p_partkey || '(x) end$/;"' || chr(9)] ELSE ['/^function f' || p_partkey || '(x) end$/;"' || chr(9)] END) AS address
  FROM part WHERE p_partkey % 97 <> 0)""")
def incremental_refresh(spark, sf_dir):
    """Tags after a second run over a tree of which one file in a hundred changed, some are new and some are gone; ``fresh`` marks what that run extracted."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    own = F.concat(F.lit("function f"), "p_partkey", F.lit("(x) end\n"))
    files = part.select(F.col("p_partkey").alias("file_ord"), F.concat(F.lit("parts/p"), "p_partkey", F.lit(".lua")).alias("rel_path"), F.lit("lua").alias("lang"), own.alias("text"))
    before = files.filter("file_ord % 1000 <> 7").withColumn("content", F.col("text").cast("binary"))
    changed = F.when(F.col("file_ord") % 100 == 0, F.concat(F.lit("function new() end\n"), "text")).otherwise(F.col("text"))
    after = files.filter("file_ord % 97 <> 0").withColumn("content", changed.cast("binary"))
    job = job_of(Config())
    cache = TagCache(spark, f"{shared_dir(spark)}/tag-cache-{uuid.uuid4().hex}", "incremental_refresh")
    extract = lambda some: extract_tags(some, job)
    cache.extract(before, extract)
    first = cache.generations()
    rows = cache.extract(after, extract)
    newest = cache.entries().select(F.col("rel_path").alias("file_name"), (~F.col("rows_gen").isin(*first)).alias("fresh"))
    return rows.join(newest, "file_name").select("name", "file_name", "address", "fresh")
