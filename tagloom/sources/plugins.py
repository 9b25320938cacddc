"""Plugin manifests (TOML), user grammars (TOML) and the plugin index (JSON), as languages and as tables."""

from __future__ import annotations

import hashlib
import os
import shutil
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..extract.tree import DECLARATIONS, known_types
from ..config import warn
from ..functions.text import version_parts, version_status
from ..plans.languages import BUILT_IN, GLEAM, Language
from ..plans.patterns import captures_of, parse_patterns

ABI = 3
_names = T.ArrayType(T.StringType())
KIND = T.StructType([T.StructField("letter", T.StringType()), T.StructField("name", T.StringType()), T.StructField("default", T.BooleanType())])
MANIFEST = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("abi_version", T.IntegerType()),
        T.StructField("extensions", _names),
        T.StructField("language", T.StringType()),
        T.StructField("aliases", _names),
        T.StructField("patterns", _names),
        T.StructField("interpreters", _names),
        T.StructField("wasm_file", T.StringType()),
        T.StructField("kinds", T.ArrayType(KIND)),
        T.StructField("internal", T.BooleanType()),
        T.StructField("path", T.StringType()),
        T.StructField("scan_ord", T.IntegerType()),
    ]
)
ENTRY = T.StructType(
    [
        *(f for f in MANIFEST.fields if f.name in ("name", "version", "language", "extensions", "aliases", "patterns", "interpreters", "kinds")),
        T.StructField("wasm_url", T.StringType()),
        T.StructField("manifest_url", T.StringType()),
        T.StructField("wasm_sha256", T.StringType()),
        T.StructField("wasm_size", T.LongType()),
        T.StructField("wasm_signature", T.StringType()),
    ]
)
INDEX = T.StructType([T.StructField("abi_version", T.IntegerType()), T.StructField("generated_at", T.StringType()), T.StructField("plugins", T.ArrayType(ENTRY))])


def load_manifest(path: str) -> dict | None:
    """A manifest with defaults filled in; a malformed one, one of another ABI or without its module is refused with a warning."""
    try:
        with open(path, "rb") as f:
            m = tomllib.load(f)
        name, abi = m["name"], int(m["abi_version"])
    except (OSError, tomllib.TOMLDecodeError, KeyError, ValueError) as e:
        warn(f"{path}: {e}")
        return None
    if abi != ABI:
        warn(f"{path}: ABI {abi}, not {ABI}")
        return None
    wasm = m.get("wasm_file", "plugin.wasm")
    if not os.path.exists(os.path.join(os.path.dirname(path), wasm)):
        warn(f"{path}: {wasm} is missing")
        return None
    return {
        "name": name,
        "version": m.get("version", "0.0.0"),
        "abi_version": abi,
        "language": m.get("language") or name,
        "wasm_file": wasm,
        "kinds": m.get("kinds"),
        "internal": bool(m.get("internal", False)),
        "path": path,
    } | {k: list(m.get(k, [])) for k in ("extensions", "aliases", "patterns", "interpreters")}


def scan_manifests(folders: list[str]) -> list[dict]:
    """Manifests in scanning order; for an extension the last one counts.

    A folder is a plugin's own or one level above several; ``<folder>/**`` stands for all below it, at any depth.
    """
    out = []
    for folder in folders:
        if folder.endswith("/**"):
            places = [here for here, _, _ in sorted(os.walk(folder[:-3]))]
        elif os.path.exists(os.path.join(folder, "plugin.toml")):
            places = [folder]
        else:
            places = sorted(e.path for e in os.scandir(folder) if e.is_dir()) if os.path.isdir(folder) else []
        for here in places:
            path = os.path.join(here, "plugin.toml")
            if os.path.exists(path) and (m := load_manifest(path)):
                out.append(m | {"scan_ord": len(out)})
    return out


def manifests_table(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.createDataFrame([tuple(m.get(f.name) for f in MANIFEST.fields) for m in scan_manifests(folders)], MANIFEST)


def extension_owners(manifests: DataFrame) -> DataFrame:
    """ext -> the last scanned manifest that claims it."""
    return manifests.select(F.explode("extensions").alias("ext"), "name", "language", "scan_ord").groupBy("ext").agg(F.max_by("name", "scan_ord").alias("name"), F.max_by("language", "scan_ord").alias("language"))


def plugin_groups(manifests: DataFrame) -> DataFrame:
    """Visible plugins with their sorted extensions, by language."""
    shown = manifests.filter(~F.coalesce("internal", F.lit(False))).select("path", "language", "name", "version", F.explode("extensions").alias("ext"))
    return shown.groupBy("path", "language", "name", "version").agg(F.sort_array(F.collect_list("ext")).alias("extensions")).orderBy("language")


def plugin_modules(folders: list[str]) -> dict[str, str]:
    """language -> Python text of the modules that manifests name (``wasm_file`` ending in ``.py``); the last scanned counts."""
    out = {}
    for m in scan_manifests(folders):
        if m["wasm_file"].endswith(".py"):
            with open(os.path.join(os.path.dirname(m["path"]), m["wasm_file"]), encoding="utf-8") as f:
                out[m["language"]] = f.read()
    return out


def plugin_languages(folders: list[str]) -> list[Language]:
    return [Language(m["language"], "plugin", tuple(m["extensions"]), tuple(m["patterns"]), tuple(m["interpreters"]), tuple(m["aliases"]), m["internal"]) for m in reversed(scan_manifests(folders))]


def user_languages(path: str) -> list[Language]:
    """``[[user_grammars]]`` of a TOML file; one that cannot be read gives a warning and none."""
    if not path or not os.path.exists(path):
        return []
    try:
        with open(path, "rb") as f:
            rows = tomllib.load(f).get("user_grammars", [])
    except (OSError, tomllib.TOMLDecodeError) as e:
        warn(f"{path}: {e}")
        return []
    out = []
    for r in rows:
        name = r["language_name"]
        default = GLEAM if name == GLEAM.name else Language(name, "user", (name,))
        out.append(Language(name, "user", tuple(r.get("extensions") or default.extensions), tuple(r.get("patterns", ())), tuple(r.get("interpreters", ()))))
    return out


def user_queries(path: str) -> dict[str, str]:
    """language -> text of its query file, where that names definitions; what cannot be read or taken gives a warning and none."""
    if not path or not os.path.exists(path):
        return {}
    try:
        with open(path, "rb") as f:
            rows = tomllib.load(f).get("user_grammars", [])
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    here, out = os.path.dirname(os.path.abspath(path)), {}
    for r in rows:
        name, file = r["language_name"], os.path.join(here, r.get("query_file_path") or "queries.scm")
        if not os.path.exists(file):
            if r.get("query_file_path"):
                warn(f"{file}: no such query file")
            continue
        try:
            with open(file, encoding="utf-8") as f:
                text = f.read()
            patterns = parse_patterns(text)
        except (OSError, ValueError) as e:
            warn(f"{file}: {e}")
            continue
        if name not in DECLARATIONS:
            warn(f"{file}: there are no trees of {name}")
        elif patterns:
            for p in patterns:
                if p.type and not p.token and p.type not in known_types(name) and any(c.startswith("definition") for c in captures_of(p)):
                    warn(f"{file}: nothing finds {p.type} of {name}")
            out[name] = text
    return out


def all_languages(plugin_dirs: list[str], user_file: str) -> list[Language]:
    return [*plugin_languages(plugin_dirs), *BUILT_IN, *user_languages(user_file)]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Plugins of an index file of our ABI, one row each; an index of another ABI has none."""
    index = spark.read.schema(INDEX).json(path, multiLine=True)
    return index.filter(F.col("abi_version") == ABI).select(F.explode("plugins").alias("p")).select("p.*")


def available(index: DataFrame, installed: DataFrame) -> DataFrame:
    """Every plugin of the index and how it stands here."""
    mine = installed.select("name", F.col("version").alias("installed_version"))
    return index.join(mine, "name", "left").select("name", "version", "installed_version", version_status(F.col("installed_version"), F.col("version")).alias("status")).orderBy("name")


def newer(a: F.Column, b: F.Column) -> F.Column:
    """1 where version a comes after b, 0 where they are equal, -1 where it comes before; null where one is no version."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x > y, 1).when(x < y, -1).when(x == y, 0)


def status_label(installed: F.Column, available: F.Column) -> F.Column:
    """How an installed version stands to the one available, as the table of plugins shows it; empty where none is installed."""
    order, shown = newer(installed, available), F.concat(F.lit("installed ("), installed)
    return (
        F.when(installed.isNull(), "")
        .when(order == -1, F.concat(F.lit("update: "), installed, F.lit(" -> "), available))
        .when(order == 1, F.concat(shown, F.lit(", newer)")))
        .when(order == 0, "installed")
        .otherwise(F.concat(shown, F.lit(")")))
    )


def updates(index: DataFrame, installed: DataFrame) -> DataFrame:
    mine = installed.select("name", F.col("version").alias("installed_version"))
    return index.join(mine, "name").filter(version_parts(F.col("installed_version")) < version_parts(F.col("version"))).select("name", "installed_version", "version")


def suggest(index: DataFrame, installed: DataFrame, found: DataFrame, handled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of extensions found in a tree (``ext``) and those handled natively (``ext``): plugins worth having, and extensions that nothing covers.

    A suggested plugin's ``label`` says whether its hits are handled natively already: all, some or none.
    """
    seen = found.select(F.lower("ext").alias("ext")).filter("ext <> ''").distinct()
    offers = index.join(installed.select("name"), "name", "left_anti").select("name", F.explode("extensions").alias("e")).select("name", F.lower("e").alias("ext")).distinct()
    known = handled.select(F.lower("ext").alias("ext")).distinct().withColumn("native", F.lit(True))
    hits = offers.join(seen, "ext", "left_semi").join(known, "ext", "left").withColumn("native", F.coalesce("native", F.lit(False)))
    label = F.when(F.bool_and("native"), "native").when(F.bool_or("native"), "partly native").otherwise("new")
    plugins = hits.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("*."), F.col("ext")))), ", ").alias("globs"), label.alias("label"))
    covered = known.select("ext").union(hits.select("ext")).distinct()
    return plugins.orderBy("name"), seen.join(covered, "ext", "left_anti").orderBy("ext")


def merged_abis(rows: DataFrame) -> DataFrame:
    """ABI versions of several lists, newest first, and the newest."""
    every = rows.select(F.explode("abis").alias("abi")).distinct()
    return every.agg(F.sort_array(F.collect_set("abi"), asc=False).alias("abis"), F.max("abi").alias("latest"))


def install(source: str, sha256: str, folder: str) -> str:
    """Copy a plugin's module into place if its checksum is right; it appears whole or not at all."""
    with open(source, "rb") as f:
        if hashlib.sha256(f.read()).hexdigest() != sha256.lower():
            raise ValueError(f"{source}: checksum differs")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, os.path.basename(source))
    shutil.copyfile(source, target + ".part")
    os.replace(target + ".part", target)
    return target


def uninstall(folder: str) -> bool:
    if not os.path.exists(os.path.join(folder, "plugin.toml")):
        return False
    shutil.rmtree(folder)
    return True
