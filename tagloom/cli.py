"""``python -m tagloom``: the command line."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import completion
from .config import Config, PluginCommand, parse_args, parser, plugin_args
from .operators import listing
from .plans.generate import generate, registry_of
from .plans.languages import UnknownLanguage, tables
from .sources import plugin_store
from .sources.files import discover
from .sources.plugins import manifests_table, read_index, suggest


def _session(config: Config) -> SparkSession:
    made = SparkSession.builder.appName("tagloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return (made if SparkSession.getActiveSession() else made.master(f"local[{config.workers}]")).getOrCreate()


def suggestions(spark: SparkSession, config: Config) -> list[str]:
    registry = registry_of(config)
    found = discover(spark, config.files, config.excludes, config.recurse)[0]
    plugins, rest = suggest(read_index(spark, config.index), manifests_table(spark, config.plugin_dirs), listing.extensions_in(found), tables(spark, registry)["lang_ext"].select("ext"))
    return [f"{r['name']}  {r['globs']}  {r['label']}" for r in plugins.collect()] + [f"*.{r['ext']}  nothing" for r in rest.collect()]


def plugin_lines(spark: SparkSession, c: PluginCommand) -> list[str]:
    base = plugin_store.base_of(c.index)
    if c.action in ("available", "install", "update") and not base:
        raise LookupError(f"no plugin index: give --plugin-index-url or set {plugin_store.BASE_VARIABLE}")
    if c.action == "available":
        return plugin_store.available_lines(spark, base, c.folder, c.refresh)
    if c.action == "install":
        return plugin_store.install_lines(spark, base, c.folder, c.name, c.force, c.refresh)
    if c.action == "uninstall":
        return plugin_store.uninstall_lines(spark, c.folder, c.name)
    if c.action == "update":
        return plugin_store.update_lines(spark, base, c.folder, c.name, c.refresh)
    return plugin_store.installed_lines(spark, c.folders, c.folder)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["completions"]:
        try:
            print(completion.script(argv[1] if len(argv) > 1 else "", parser(), ["completions", "plugin"]))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if argv[:1] == ["plugin"]:
        command = plugin_args(argv[1:])
        try:
            print("\n".join(plugin_lines(_session(Config()), command)))
        except (LookupError, OSError, ValueError) as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    config = parse_args(argv)
    spark = _session(config)
    try:
        if config.command == "list_kinds":
            lines = listing.list_kinds(spark, registry_of(config), config.argument)
        elif config.command == "list_maps":
            lines = listing.list_maps(spark, registry_of(config), config.argument)
        elif config.command == "list_languages":
            lines = listing.list_languages(spark, registry_of(config))
        elif config.command == "suggest_plugins":
            lines = suggestions(spark, config)
        elif config.command == "print_language":
            files = discover(spark, config.files, config.excludes, config.recurse)[0]
            rows = listing.print_languages(files, registry_of(config), config.guess).orderBy("file_ord").select(F.concat_ws(": ", "rel_path", "lang").alias("line"))
            lines = [r["line"] for r in rows.collect()]
        else:
            return generate(spark, config)
    except UnknownLanguage as e:
        known = ", ".join(sorted({lang.name for lang in registry_of(Config()).languages}))
        print(f"unknown language {e}; known: {known}", file=sys.stderr)
        return 1
    print("\n".join(lines))
    return 0
