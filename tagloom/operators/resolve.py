"""Which language is a file? A ladder of broadcast joins; content is read only where names do not settle it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.modeline import modeline_type
from ..plans.languages import Registry, tables
from ..sources.files import read_ends


def candidates(files: DataFrame, registry: Registry, path: str = "rel_path") -> DataFrame:
    """All columns of ``files`` and ``cands``: languages in order of rank, of the first stage with any.

    Stages: a forced language; regexes of the path; patterns of the base name; the extension.
    The tables are the configuration's, so they are broadcast whatever the number of files.
    Rows with a null path have no candidates.
    """
    if registry.forced:
        return files.withColumn("cands", F.array(F.lit(registry.forced)))
    t = tables(files.sparkSession, registry)
    base = fx.byte_text(F.regexp_extract(F.col(path), r"[^/]*$", 0))
    own = files.columns
    matched = files.withColumn("_ext", fx.extension(F.col(path))).withColumn("_base", base)
    found = []
    # each table becomes one row of arrays: a probe of every file, without a row for each pair
    globs = F.broadcast(t["lang_glob"].agg(F.array_sort(F.collect_list(F.struct("priority", "rx", "lang"))).alias("_globs")))
    exts = F.broadcast(t["lang_ext"].groupBy(F.col("ext").alias("_ext")).agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "lang"))), lambda x: x["lang"]).alias("_by_ext")))
    if registry.regexes:
        rexprs = F.broadcast(t["lang_rexpr"].agg(F.array_sort(F.collect_list(F.struct("priority", "rx", "lang"))).alias("_rexprs")))
        matched = matched.crossJoin(rexprs)
        found.append(F.expr(f"array_distinct(transform(filter(_rexprs, x -> {path} rlike x.rx), x -> x.lang))"))
    matched = matched.crossJoin(globs).join(exts, "_ext", "left")
    # one pattern of all, compiled once, lets few names through to the patterns one by one
    some = F.col("_base").rlike("|".join(fx.glob_regex(g) for g, _ in registry.patterns)) if registry.patterns else F.lit(False)
    found.append(F.when(some, F.expr("array_distinct(transform(filter(_globs, x -> _base rlike x.rx), x -> x.lang))")))
    found.append(F.array_distinct("_by_ext"))
    first = F.coalesce(*(F.when(F.size(c) > 0, c) for c in found), F.array().cast("array<string>"))
    return matched.withColumn("cands", first).select(*own, "cands")


def resolved_paths(files: DataFrame, registry: Registry, guess: bool = False) -> DataFrame:
    """All columns of a table of paths and ``lang``: names first, and a bounded look into files that names do not settle."""
    unsettled = F.size("cands") > 1
    may_run = F.lit(True) if guess else F.coalesce(F.col("is_exec"), F.lit(False))
    ask = unsettled | ((F.size("cands") == 0) & may_run)
    asked = candidates(files, registry).withColumn("ask", ask).drop("cands")
    return resolve(read_ends(asked, "ask"), registry, guess).drop("content")


def by_interpreter(head: F.Column, registry: Registry) -> F.Column:
    """Language of the interpreter that a first line names, tried again without its version."""
    if not registry.interpreters:
        return F.lit(None).cast("string")
    name = F.lower(fx.shebang_interpreter(head))
    table = F.create_map(*(F.lit(x) for pair in registry.interpreters.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, fx.strip_version(name)))


def by_name(name: F.Column, registry: Registry) -> F.Column:
    """Language of a name or alias, ignoring case, tried again without ``-mode``."""
    table = F.create_map(*(F.lit(x) for pair in {**registry.aliases, **registry.known}.items() for x in pair))
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.regexp_replace(key, "-mode$", "")))


def by_content(cands: F.Column, content: F.Column) -> F.Column:
    """The first candidate, but C++ for the pair of C and C++ whose first bytes look like it, else C."""
    pair = (F.size(cands) == 2) & F.array_contains(cands, "c") & F.array_contains(cands, "c++")
    return F.when(pair, F.when(fx.looks_like_cpp(content), "c++").otherwise("c")).otherwise(F.try_element_at(cands, F.lit(1)))


def resolve(files: DataFrame, registry: Registry, guess: bool = False, content: str = "content", path: str = "rel_path") -> DataFrame:
    """All columns of ``files`` and ``lang`` (null where nothing settles it).

    ``content`` (binary or text) is touched for ambiguous and unresolved files only. A first
    line's interpreter counts for executable files (``is_exec``) or with ``guess``; a mode
    line with ``guess`` only.
    """
    named = candidates(files, registry, path)
    unsettled = F.size("cands") == 0
    may_run = F.lit(True) if guess else (F.coalesce(F.col("is_exec"), F.lit(False)) if "is_exec" in files.columns else F.lit(False))
    lang = F.when(unsettled, F.when(may_run, by_interpreter(fx.lossy_text(F.substring(F.col(content), 1, 256)), registry))).otherwise(by_content(F.col("cands"), F.col(content)))
    out = named.withColumn("lang", lang)
    if guess:
        mode = modeline_type(F.when(F.col("lang").isNull(), F.col(content).cast("binary")))
        out = out.withColumn("_mode", mode).withColumn("lang", F.coalesce("lang", by_name(F.col("_mode"), registry))).drop("_mode")
    return out.drop("cands")
