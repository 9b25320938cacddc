"""The plugin commands: an index that is fetched and cached, installation, updates, and the tables that are printed.

Everything here is about a few files of one user and runs on the driver; the rows that are
compared and counted are DataFrames (``plugins.py``).
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import time
import tomllib
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import warn
from . import plugins

TTL = 3_600
BASE_VARIABLE = "TAGLOOM_PLUGIN_INDEX"

# Lines that the plugin commands print, which scripts may look for.
NONE_AVAILABLE = "No plugins available for ABI {abi}."
NONE_DETECTED = "No plugins detected."
FOLDER = "Plugin directory: {folder}"
INSTALLED = "Installed `{name}` {version} to {folder}"
NOT_INSTALLED = "`{name}` is not installed under {folder}"
UNINSTALLED = "Uninstalled `{name}` from {folder}"
NONE_INSTALLED = "No plugins installed under {folder}."
UPDATED = "Updated `{name}` {old} -> {new}"
UP_TO_DATE = "All plugins up to date."


def base_of(flag: str, default: str = "") -> str:
    """Where the index is: the flag, else the environment, else the default; empty values do not count."""
    return flag or os.environ.get(BASE_VARIABLE, "") or default


def index_location(base: str) -> str:
    """The index of our ABI below a base, or the base itself where it names a JSON file."""
    return base if base.endswith(".json") else f"{base.rstrip('/')}/{plugins.ABI}/index.json"


def fetch(location: str) -> bytes:
    """Bytes of a path or an address."""
    address = location if "://" in location else "file://" + os.path.abspath(location)
    with urllib.request.urlopen(address, timeout=30) as answer:
        return answer.read()


def cache_folder() -> str:
    return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "tagloom")


def cached_index(base: str, refresh: bool = False, folder: str | None = None) -> str:
    """Path of the index as a local file: the cached one while it is younger than TTL, else fetched anew.

    What cannot be fetched gives the cached one, however old, with a warning; without one the error stays.
    """
    location = index_location(base)
    folder = folder or cache_folder()
    path = os.path.join(folder, f"index-v{plugins.ABI}-{hashlib.sha256(location.encode()).hexdigest()[:12]}.json")
    if not refresh and os.path.exists(path) and time.time() - os.path.getmtime(path) < TTL:
        return path
    try:
        body = fetch(location)
    except (OSError, urllib.error.URLError) as e:
        if os.path.exists(path):
            warn(f"{location} cannot be fetched ({e}): using what was fetched before")
            return path
        raise
    os.makedirs(folder, exist_ok=True)
    draft = f"{path}.{os.getpid()}"
    with open(draft, "wb") as out:
        out.write(body)
    os.replace(draft, path)
    return path


def widths(rows: DataFrame, headers: list[str]) -> DataFrame:
    """One row: the width of each column, its longest cell or its header; nulls are empty, and no rows leave the headers."""
    longest = {c: F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) for c in rows.columns}
    return rows.agg(*(F.greatest(F.lit(len(h)), n).alias(c) for h, (c, n) in zip(headers, longest.items())))


def table_lines(rows: DataFrame, headers: list[str]) -> list[str]:
    """A table as lines, four blanks between columns; the last column is not filled up."""
    size = widths(rows, headers).first()
    cells = [headers, *([v or "" for v in r] for r in rows.collect())]  # an index's plugins
    return ["    ".join([*(c.ljust(n) for c, n in zip(row[:-1], size)), row[-1]]).rstrip() for row in cells]


def installed(spark: SparkSession, folder: str) -> DataFrame:
    """name, version and folder of the plugins below a folder; what cannot be read is left out."""
    found = {}
    for here, _, names in sorted(os.walk(folder)):
        if "plugin.toml" in names:
            try:
                with open(os.path.join(here, "plugin.toml"), "rb") as f:
                    m = tomllib.load(f)
                found[m["name"]] = (m["name"], m.get("version", "0.0.0"), here)
            except (OSError, KeyError, tomllib.TOMLDecodeError):
                continue
    return spark.createDataFrame(list(found.values()), "name string, version string, folder string")


def plain_name(name: str) -> str:
    """``name`` if it is one component of a path and stays below the folder it is joined to."""
    if not name or name in (".", "..") or name.startswith(".") or any(c in name for c in "/\\\0:"):
        raise ValueError(f"{name!r} is no plain name")
    return name


def place(entry: dict, folder: str) -> str:
    """Fetch a plugin's module and manifest and put them into ``folder/<name>`` together, once checksum, name and ABI are right.

    What was there is renamed away first and goes last; if the new folder cannot take its
    place, it comes back.
    """
    name = plain_name(entry["name"])
    module = fetch(entry["wasm_url"])
    if hashlib.sha256(module).hexdigest() != (entry["wasm_sha256"] or "").lower():
        raise ValueError(f"{name}: checksum differs")
    manifest = fetch(entry["manifest_url"])
    said = tomllib.loads(manifest.decode())
    if said.get("name") != name:
        raise ValueError(f"{name}: its manifest is that of {said.get('name')!r}")
    if said.get("abi_version") != plugins.ABI:
        raise ValueError(f"{name}: its manifest is for ABI {said.get('abi_version')!r}, not {plugins.ABI}")
    file_name = plain_name(said.get("wasm_file", "plugin.wasm"))
    if file_name == "plugin.toml":
        raise ValueError(f"{name}: its module would take the manifest's place")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, name)
    if os.path.islink(target) or os.path.exists(target) and not os.path.exists(os.path.join(target, "plugin.toml")):
        raise ValueError(f"{target} is no plugin's folder")
    draft = tempfile.mkdtemp(prefix=".new-", dir=folder)
    try:
        for file, body in ((file_name, module), ("plugin.toml", manifest)):
            with open(os.path.join(draft, file), "wb") as out:
                out.write(body)
        old = tempfile.mkdtemp(prefix=".old-", dir=folder)
        try:
            if os.path.exists(target):
                os.rename(target, os.path.join(old, name))
            try:
                os.rename(draft, target)
            except OSError:
                if os.path.exists(os.path.join(old, name)):
                    os.rename(os.path.join(old, name), target)
                raise
        finally:
            shutil.rmtree(old, ignore_errors=True)
    except BaseException:
        shutil.rmtree(draft, ignore_errors=True)
        raise
    return target


def available_lines(spark: SparkSession, base: str, folder: str, refresh: bool = False) -> list[str]:
    index = plugins.read_index(spark, cached_index(base, refresh))
    if index.isEmpty():
        return [NONE_AVAILABLE.format(abi=plugins.ABI)]
    mine = installed(spark, folder).select("name", F.col("version").alias("mine"))
    status = plugins.status_label(F.col("mine"), F.col("version"))
    rows = index.join(mine, "name", "left").orderBy("name").select("name", "version", F.coalesce("language", F.lit("")).alias("language"), F.array_join("extensions", ", ").alias("extensions"), status.alias("status"))
    return table_lines(rows, ["NAME", "VERSION", "LANGUAGE", "EXTENSIONS", "STATUS"])


def installed_lines(spark: SparkSession, folders: list[str], folder: str) -> list[str]:
    rows = plugins.plugin_groups(plugins.manifests_table(spark, [*folders, f"{folder}/**"])).select("language", F.array_join("extensions", ", ").alias("extensions"))
    lines = table_lines(rows, ["LANGUAGE", "EXTENSIONS"]) if not rows.isEmpty() else [NONE_DETECTED]
    return [FOLDER.format(folder=folder), *lines]


def install_lines(spark: SparkSession, base: str, folder: str, name: str, force: bool = False, refresh: bool = False) -> list[str]:
    entry = plugins.read_index(spark, cached_index(base, refresh)).filter(F.col("name") == name).first()
    if entry is None:
        raise LookupError(f"no plugin named `{name}` for ABI {plugins.ABI}; `plugin available` lists them")
    mine = installed(spark, folder).filter(F.col("name") == name).select("version", plugins.newer(F.lit(entry["version"]), F.col("version")).alias("order")).first()
    if mine and not force and mine["order"] is not None and mine["order"] <= 0:
        return [f"`{name}` {mine['version']} is installed and {'up to date' if mine['order'] == 0 else 'newer than ' + entry['version'] + ' (--force replaces it)'}."]
    return [INSTALLED.format(name=name, version=entry["version"], folder=place(entry.asDict(), folder))]


def uninstall_lines(spark: SparkSession, folder: str, name: str) -> list[str]:
    mine = installed(spark, folder).filter(F.col("name") == name).first()
    if mine is None:
        return [NOT_INSTALLED.format(name=name, folder=folder)]
    plugins.uninstall(mine["folder"])
    return [UNINSTALLED.format(name=name, folder=mine["folder"])]


def update_lines(spark: SparkSession, base: str, folder: str, name: str = "", refresh: bool = False) -> list[str]:
    mine = installed(spark, folder)
    if mine.isEmpty():
        return [NONE_INSTALLED.format(folder=folder)]
    if name and mine.filter(F.col("name") == name).isEmpty():
        raise LookupError(NOT_INSTALLED.format(name=name, folder=folder))
    index = plugins.read_index(spark, cached_index(base, refresh))
    old = plugins.updates(index, mine).filter((F.col("name") == name) | F.lit(not name)).collect()
    entries = {r["name"]: r.asDict() for r in index.collect()}
    for r in old:
        place(entries[r["name"]], folder)
    return [UPDATED.format(name=r["name"], old=r["installed_version"], new=r["version"]) for r in old] or [UP_TO_DATE]
