"""A table of immutable shards, kept few and large by size-tiered compaction.

``append`` writes arrivals as small Parquet shards. ``compact`` puts the live shards in
tiers of similar size and merges runs of a tier into files near the target size. Either
commits a new version: a manifest that names parts, each of which lists live shards. A
commit writes only the parts that it changes, so an append costs its own shards and not
the table's. The manifest is put in place under its version's name in one step that fails
if another writer made that version first; the loser tries again on the new version.
Readers take the latest manifest, so they see all of a commit or nothing of it; replaced
shards stay for readers of older versions until ``vacuum``.

A file system must rename without replacing (HDFS does so in one step). On local disks a
lock file stands for that; a lock whose writer died is taken over after LOCK_SECONDS.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .workspace import free_name, quoted

TARGET = 64 << 20
FANOUT = 4
#: Shards that one part of a manifest lists, and that one merging job takes (a broadcast row each), at most.
PART_SHARDS = 10_000
LOCK_SECONDS = 60.0
RETRIES = 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def tier(size: int, target: int, fanout: int = FANOUT) -> int:
    """0 for a shard of target size, one more for each factor of ``fanout`` below it."""
    return max(0, math.ceil(math.log(target / max(1, size), fanout) - 1e-9))


def plan(shards: list[dict], target: int, fanout: int = FANOUT) -> list[list[dict]]:
    """Runs of live shards to merge, each of one tier and together not above the target (or two shards at least).

    From the smallest tier up: a tier with ``fanout`` shards or more is cut into runs; what
    a run makes counts for its own tier, so small shards reach the target in one rewrite.
    """
    tiers: dict[int, list[list[dict]]] = {}
    for s in sorted(shards, key=lambda s: (s["bytes"], s["path"])):
        tiers.setdefault(tier(s["bytes"], target, fanout), []).append([s])
    size = lambda run: sum(s["bytes"] for s in run)
    for t in range(max(tiers, default=0), 0, -1):
        runs = tiers.get(t, [])
        if len(runs) < fanout:
            continue
        tiers[t], now = [], []
        for run in runs:
            if now and size(now) + size(run) > target:
                tiers.setdefault(min(t - 1, tier(size(now), target, fanout)), []).append(now)
                now = []
            now = now + run
        tiers.setdefault(min(t - 1, tier(size(now), target, fanout)), []).append(now)
    return [run for runs in tiers.values() for run in runs if len(run) > 1]


class ShardStore:
    """A shard table under ``root``, any folder that Spark's file systems reach.

    The table's columns may have any names. Rows come back as they were appended: nulls,
    repeated rows and empty tables included, in no order. Later arrivals must have the same
    columns and types as the first, in any order; others are refused (ValueError).
    """

    def __init__(self, spark: SparkSession, root: str, lock_seconds: float = LOCK_SECONDS):
        self.spark, self.root, self.lock_seconds = spark, root.rstrip("/"), lock_seconds
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._no_replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """Name and age in seconds of the files in a folder."""
        path = self._path(folder)
        now = time.time()
        return [(f.getPath().getName(), now - f.getModificationTime() / 1000) for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self._names(f"{self.root}/manifests") if n.startswith("v") and n.endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, what: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/manifests/{name}"), False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()

    def _head(self, version: int | None = None) -> dict:
        """version, schema and parts (name, shards, settled) of a version, default the latest."""
        if version is None:
            version = max(self.versions(), default=0)
        return self._load(f"v{version:012d}.json") if version else {"version": 0, "schema": None, "parts": []}

    def _shards(self, parts: list[dict]) -> list[dict]:
        return [s for p in parts for s in self._load(p["name"])["shards"]]

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and all live shards (path, bytes) of a version."""
        head = self._head(version)
        return {"version": head["version"], "schema": head["schema"], "shards": self._shards(head["parts"])}

    def _parts(self, shards: list[dict], target: int = TARGET) -> list[dict]:
        """Write parts that list ``shards``, those of target size apart from the others."""
        out = []
        for settled in (True, False):
            some = [s for s in shards if (tier(s["bytes"], target) == 0) == settled]
            for i in range(0, len(some), PART_SHARDS):
                part = some[i : i + PART_SHARDS]
                out.append({"name": f"part-{uuid.uuid4().hex}.json", "shards": len(part), "settled": settled})
                self._save(out[-1]["name"], {"shards": part})
        return out

    def _commit(self, base: dict, parts: list[dict], schema: str) -> dict:
        """Written whole under a private name, then renamed to the version's name, which must be free."""
        new = {"version": base["version"] + 1, "schema": schema, "parts": parts}
        name = f"v{new['version']:012d}"
        draft, lock = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{name}.lock")
        self._save(draft.getName(), new)
        try:
            self._take(lock, name)
            try:
                self._context.rename(draft, self._path(f"{self.root}/manifests/{name}.json"), self._no_replace)
            except Exception as e:
                if self._fs.exists(self._path(f"{self.root}/manifests/{name}.json")):
                    raise Conflict(f"version {new['version']} was committed by another writer") from e
                raise
            finally:
                self._fs.delete(lock, False)
        finally:
            self._fs.delete(draft, False)
        return new

    def _take(self, lock, name: str) -> None:
        """Make the lock of a version, or take over one that was left behind; Conflict if another writer holds or used it."""
        busy = Conflict(f"version {name} is being committed by another writer")
        if self._fs.exists(self._path(f"{self.root}/manifests/{name}.json")):
            raise busy
        if self._make(lock):
            return
        age = dict(self._names(f"{self.root}/manifests")).get(lock.getName(), 0.0)
        if age < self.lock_seconds:
            raise busy
        # of several that find it old, one moves it away
        if not self._fs.rename(lock, self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")) or not self._make(lock):
            raise busy

    def _make(self, lock) -> bool:
        """Whether the file was made by this call; some file systems say that it exists by an error."""
        try:
            return self._fs.createNewFile(lock)
        except Exception:
            if self._fs.exists(lock):
                return False
            raise

    def _agree(self, change) -> dict:
        """Commit change(head) -> (parts, schema) or None, again on the newer version whenever another writer was first."""
        for turn in range(RETRIES):
            head = self._head()
            made = change(head)
            if made is None:
                return head
            try:
                return self._commit(head, *made)
            except Conflict:
                if turn == RETRIES - 1:
                    raise
                # the other writer is done soon, or its lock grows old
                time.sleep(min(self.lock_seconds, 0.05 * 2 ** min(turn, 8)) + 0.01)
        raise Conflict("unreachable")

    def _written(self, folder: str) -> list[dict]:
        files = self._fs.listStatus(self._path(folder)) if self._fs.exists(self._path(folder)) else []
        return [{"path": f"{folder}/{f.getPath().getName()}", "bytes": f.getLen()} for f in files if f.getPath().getName().endswith(".parquet")]

    def append(self, rows: DataFrame) -> dict:
        """Add ``rows`` as new shards, one for each of its partitions, and commit. No rows: a commit without new shards."""
        schema = self._head()["schema"]
        kinds = lambda s: {f.name: f.dataType for f in s.fields}
        columns = list(rows.columns)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"

        def fits(schema: str | None) -> None:
            if schema is not None and kinds(StructType.fromJson(json.loads(schema))) != kinds(rows.schema):
                raise ValueError("the rows' columns or types are not those of the table")

        fits(schema)
        if schema is not None:
            columns = StructType.fromJson(json.loads(schema)).names
        rows = rows.select(*map(quoted, columns))
        rows.write.option("compression", "zstd").parquet(folder)
        parts = self._parts(self._written(folder))

        def change(head: dict):
            fits(head["schema"])
            return head["parts"] + parts, head["schema"] or rows.schema.json()

        return self._agree(change)

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> dict:
        """Merge what ``plan`` says and commit, a job and a commit for at most PART_SHARDS merged shards each.

        Nothing to merge commits nothing. Of each job's shards, those that another compaction
        replaced meanwhile make it a Conflict, and its own files are left to ``vacuum``.
        """
        head = self._head()
        open_parts = [p for p in head["parts"] if not p["settled"]]
        runs, batch = plan(self._shards(open_parts), target, fanout), []
        for i, run in enumerate(runs):
            batch.append(run)
            if i + 1 == len(runs) or sum(map(len, batch)) + len(runs[i + 1]) > PART_SHARDS:
                head = self._merge(batch, head["schema"], target)
                batch = []
        return head

    def _merge(self, runs: list[list[dict]], schema: str, target: int) -> dict:
        shards = [s for run in runs for s in run]
        rows = self._read(shards, schema)
        # one row for each shard that is merged, PART_SHARDS at most: metadata, not data
        path, number = free_name(rows.columns, "path"), free_name(rows.columns, "run")
        names = [(self._key(s["path"]), i) for i, run in enumerate(runs) for s in run]
        of = F.broadcast(self.spark.createDataFrame(names, f"{path} string, {number} int"))
        file = F.element_at(F.split(rows.metadataColumn("_metadata").getField("file_path"), "/data/"), -1)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # a partition for each run, which is a file of the target size at most
        dealt = rows.select("*", file.alias(path)).join(of, path).repartitionById(len(runs), F.col(number))
        dealt.select(*map(quoted, rows.columns)).write.option("compression", "zstd").parquet(folder)
        made = self._written(folder)
        gone = {s["path"] for s in shards}

        def change(head: dict):
            keep, again = [], []
            for p in head["parts"]:
                if p["settled"]:
                    keep.append(p)
                    continue
                listed = self._shards([p])
                if gone.isdisjoint(s["path"] for s in listed):
                    keep.append(p)
                else:
                    again += listed
            if not gone <= {s["path"] for s in again}:
                raise Conflict("another compaction replaced some of the shards")
            # settled parts that are not full are written anew with what comes, so that they stay few
            loose = [p for p in keep if p["settled"] and p["shards"] < PART_SHARDS // 2]
            keep = [p for p in keep if p not in loose]
            return keep + self._parts(self._shards(loose) + [s for s in again if s["path"] not in gone] + made, target), head["schema"]

        head = self._head()
        for turn in range(RETRIES):
            try:
                return self._commit(head, *change(head))
            except Conflict:
                newer = self._head()
                if turn == RETRIES - 1 or not gone <= {s["path"] for s in self._shards([p for p in newer["parts"] if not p["settled"]])}:
                    raise
                time.sleep(min(self.lock_seconds, 0.05 * 2 ** min(turn, 8)) + 0.01)
                head = newer
        raise Conflict("unreachable")

    @staticmethod
    def _key(path: str) -> str:
        return path.rsplit("/data/", 1)[1]

    def _read(self, shards: list[dict], schema: str | None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType([])
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(s["path"] for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (default: the latest); no commits give an empty table without columns."""
        m = self.manifest(version)
        return self._read(m["shards"], m["schema"])

    def vacuum(self, grace_seconds: float = 3_600.0) -> int:
        """Delete what the latest version does not need, and return how many shards that were.

        Shards that older versions list go at once, with those versions. Files that no version
        lists are what failed or unfinished commits left: they go when older than ``grace_seconds``.
        """
        head, listed = self._head(), set()
        live = {s["path"] for s in self._shards(head["parts"])}
        parts = {p["name"] for p in head["parts"]}
        for v in self.versions():
            if v < head["version"]:
                for p in self._head(v)["parts"]:
                    if p["name"] not in parts:
                        parts.add(p["name"])
                        listed |= {s["path"] for s in self._shards([p])}
        gone = listed - live
        folders = [n for n, _ in self._names(f"{self.root}/data")]
        for folder in folders:
            for name, age in self._names(f"{self.root}/data/{folder}"):
                path = f"{self.root}/data/{folder}/{name}"
                if name.endswith(".parquet") and path not in live and path not in gone and age >= grace_seconds:
                    gone.add(path)
        for path in gone:
            self._fs.delete(self._path(path), False)
        for name, age in self._names(f"{self.root}/manifests"):
            old = name.endswith(".json") and name.startswith("v") and int(name[1:-5]) < head["version"]
            unused = name.startswith("part-") and name not in {p["name"] for p in head["parts"]}
            if old or (unused and (name in parts or age >= grace_seconds)) or (name.startswith(".") and not name.endswith(".crc") and age >= grace_seconds):
                self._fs.delete(self._path(f"{self.root}/manifests/{name}"), False)
        return len(gone)
