"""The whole run: find, resolve, read, extract, unite, sort, write."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.extract import described, errors_only, extract_tags, job_of, tags_only
from ..operators.resolve import resolve, resolved_paths
from ..operators.tags import append
from ..session import written
from ..sources.files import balanced, discover
from ..sources.plugin_store import cache_folder
from ..sources.plugins import all_languages, scan_manifests
from ..sources.tag_cache import TagCache
from ..sources.tagfile import is_tags_file, output_path, read_tags, write_tags, write_tags_distributed
from .languages import Registry, build_registry


def registry_of(config: Config) -> Registry:
    return build_registry(all_languages(config.plugin_dirs, config.user_grammars), config.edits, config.force)


def tags_of_files(files: DataFrame, config: Config, registry: Registry | None = None) -> DataFrame:
    """Tags, and error rows, of a table of files with rel_path, file_ord, perhaps is_exec, and content or the path to read."""
    registry = registry or registry_of(config)
    plugins = frozenset(name for (tier, name), won in registry.won.items() if tier == "plugin" and won)
    if "content" in files.columns:
        return extract_tags(resolve(files, registry, config.guess), job_of(config, plugins))
    # whole files are read last, one at a time, and only those with a language
    return extract_tags(resolved_paths(files, registry, config.guess), job_of(config, plugins), content=None)


def cached_tags(files: DataFrame, config: Config, base: str) -> DataFrame:
    """As ``tags_of_files``, for files on paths; of languages that ``config.cached`` names only files that changed are extracted."""
    registry = registry_of(config)
    plugins = frozenset(name for (tier, name), won in registry.won.items() if tier == "plugin" and won)
    job, spark = job_of(config, plugins), files.sparkSession
    owners = {m["name"]: m["language"] for m in scan_manifests(config.plugin_dirs)}
    langs = {owners.get(name, name) for name in config.cached}
    paths = written(resolved_paths(files, registry, config.guess), "resolved")
    mine = F.lit(True) if "all" in langs else F.coalesce(F.col("lang").isin(*langs), F.lit(False))
    cache = TagCache(spark, os.path.join(cache_folder(), "tags"), repr((os.path.abspath(base), described(job))))
    return cache.extract(paths.filter(mine), lambda some: extract_tags(some, job, content=None)).unionByName(extract_tags(paths.filter(~mine), job, content=None))


def generate(spark: SparkSession, config: Config, cwd: str = ".") -> int:
    """Write the tags file of a configuration; the exit code is 1 only if nothing was found and something failed."""
    target = output_path(config.tag_file, cwd)
    base = cwd if target == "-" else os.path.dirname(os.path.abspath(target.rstrip("/")))
    files, errors = discover(spark, config.files, config.excludes, config.recurse, base)
    failed = False
    for e in errors.toLocalIterator():
        failed = True
        print(e["error"], file=sys.stderr)
    if failed and files.isEmpty():
        return 1
    old = None
    if config.append and target != "-":
        if os.path.exists(target):
            if not is_tags_file(spark, target):
                print(f"{target} is no tags file", file=sys.stderr)
                return 1
            old = read_tags(spark, target)
    files = balanced(files, config.workers)
    rows = written(cached_tags(files, config, base) if config.cached else tags_of_files(files, config), "tags")
    for r in errors_only(rows).toLocalIterator():
        print(f"{r['file_name']}: {r['error']}", file=sys.stderr)
    tags = tags_only(rows)
    # a name that ends with a slash asks for a folder of parts
    (write_tags_distributed if target.endswith("/") else write_tags)(append(tags, old) if old is not None else tags, target, config.sort)
    return 0
