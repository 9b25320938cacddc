"""What the engine knows, as tables and as the lines that are printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..plans.languages import Registry, UnknownLanguage, kinds_of, kinds_table, language_maps, tables
from .resolve import resolve, resolved_paths


def list_kinds(spark: SparkSession, registry: Registry, language: str = "") -> list[str]:
    if language:
        name = registry.named(language)
        if name is None:
            raise UnknownLanguage(language)
        rows = kinds_of(name)
        return [f"{'#LETTER':<8} {'NAME':<24} ENABLED", *(f"{k.letter:<8} {k.names[0]:<24} {'yes' if k.default else 'no'}" for k in rows)]
    out = []
    for name in sorted({lang.name for lang in registry.languages}):
        kinds = kinds_of(name) if any(lang.name == name and (lang.tier != "query" or registry.won.get(("plugin", name))) for lang in registry.languages) else []
        if kinds:
            out += [name, *(f"    {k.letter}  {k.names[0]}{'' if k.default else ' [off]'}" for k in kinds)]
    return out


def maps_table(spark: SparkSession, registry: Registry, language: str = "") -> DataFrame:
    """lang and items: its extensions and then its patterns, as one line shows them."""
    m = language_maps(spark, registry)
    if language:
        m = m.filter(F.lower("lang") == language.lower())
    items = F.concat(F.transform("extensions", lambda e: F.concat(F.lit("."), e)), F.col("patterns"))
    return m.select("lang", F.array_join(items, " ").alias("items")).orderBy("lang")


def list_maps(spark: SparkSession, registry: Registry, language: str = "") -> list[str]:
    return [f"{r['lang']:<12} {r['items']}" for r in maps_table(spark, registry, language).collect()]


def _label() -> F.Column:
    native = F.col("kind").isin("native", "query")
    kind = F.when(native, "native").otherwise(F.col("kind"))
    return F.when(~F.col("won"), F.concat(F.lit("["), kind, F.lit(", overridden]"))).when(native, "").otherwise(F.concat(F.lit("["), kind, F.lit("]")))


def languages_table(spark: SparkSession, registry: Registry) -> DataFrame:
    """name and label of every source, those that won before those they overrule."""
    return tables(spark, registry)["sources"].select("name", _label().alias("label"), "won").orderBy(F.lower("name"), F.desc("won")).drop("won")


def list_languages(spark: SparkSession, registry: Registry) -> list[str]:
    return [f"{r['name']:<18}{r['label']}".rstrip() if r["label"] else r["name"] for r in languages_table(spark, registry).collect()]


def print_languages(files: DataFrame, registry: Registry, guess: bool = False) -> DataFrame:
    """path and lang, ``NONE`` for files that nothing settles. Without ``content`` the paths are read, as far as need be."""
    rows = resolve(files, registry, guess) if "content" in files.columns else resolved_paths(files, registry, guess)
    return rows.select("file_ord", "rel_path", F.coalesce("lang", F.lit("NONE")).alias("lang"))


def extensions_in(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Each extension once, in lower case."""
    return files.select(F.lower(extension(F.col(path))).alias("ext")).filter("ext <> ''").distinct()


def _extensions_counted(files: DataFrame, path: str) -> DataFrame:
    """ext and files: how many names have an extension. Shuffles a row an extension and task."""
    return files.select(extension(F.col(path)).alias("ext")).filter("ext <> ''").groupBy("ext").agg(F.count("*").alias("files"))


def maps_of_files(files: DataFrame, registry: Registry, path: str = "rel_path") -> DataFrame:
    """lang, items, files: the map of each language that claims the extension of some file."""
    claims = tables(files.sparkSession, registry)["lang_ext"].select("ext", "lang")
    counted = _extensions_counted(files, path).join(F.broadcast(claims), "ext").groupBy("lang").agg(F.sum("files").alias("files"))
    return counted.join(F.broadcast(maps_table(files.sparkSession, registry)), "lang").select("lang", "items", "files")


def languages_of_files(files: DataFrame, registry: Registry, path: str = "rel_path") -> DataFrame:
    """name, label, files: every source of a language, overruled or not, whose extensions some file has."""
    ours = tables(files.sparkSession, registry)["sources"].select("name", _label().alias("label"), F.explode("extensions").alias("ext"))
    return _extensions_counted(files, path).join(F.broadcast(ours), "ext").groupBy("name", "label").agg(F.sum("files").alias("files"))


def kinds_of_tags(tags: DataFrame) -> DataFrame:
    """lang, letter, name, is_default, canonical, tags: tags counted by kind; a letter that its language lacks has no name."""
    counted = tags.groupBy("lang", "letter").agg(F.count("*").alias("tags"))
    return counted.join(F.broadcast(kinds_table(tags.sparkSession).drop("ord")), ["lang", "letter"], "left").select("lang", "letter", "name", "is_default", "canonical", "tags")


__all__ = ["kinds_of_tags", "kinds_table", "languages_of_files", "list_kinds", "list_languages", "list_maps", "languages_table", "maps_of_files", "maps_table", "print_languages", "extensions_in"]
