"""Tags kept from run to run, so that only files that changed are read and extracted.

The cache is a folder of generations, each a pair of Parquet tables that is written once and
then made visible by one rename: ``files`` says with which size, time and content hash a file
was last seen and which generation holds its rows; ``rows`` holds rows that were extracted in
that generation. A file's newest entry counts. A run joins the files it found with those
entries: equal size and time, or else equal content, take their rows from where they lie;
the others are extracted and form the next generation. Files that are gone simply find no
partner. What another configuration extracted lies in another folder (``key``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXTRACTED
from ..session import written
from .storage import opened

ENTRY = "rel_path string, lang string, stat string, hash string, rows_gen string, gen string"
ROWS = "rel_path string, tag_ord long, name string, file_name string, address string, kind string, fields array<struct<key:string,value:string>>, gen string"
#: Generations that are read side by side; more are made one.
GENERATIONS = 16


def content_hash(files: DataFrame) -> DataFrame:
    """rel_path and hash (SHA-256 of the content, null if it cannot be read) of files with content or a path."""
    if "content" in files.columns:
        return files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as f:
                        out.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(out, pa.string())], ["rel_path", "hash"])

    return files.select("rel_path", "path").mapInArrow(run, "rel_path string, hash string")


class TagCache:
    """Generations below ``folder``/``key``; ``key`` stands for all that extraction depends on besides the files."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.root = spark, f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def generations(self) -> list[str]:
        """Names of what is committed, in the order of commits."""
        path, fs = self._path()
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(n for n in names if n.startswith("gen-"))

    def _tables(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{g}/{name}" for g in self.generations()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The newest entry of each file."""
        newest = F.max_by(F.struct("lang", "stat", "hash", "rows_gen"), "gen").alias("e")
        return self._tables("files", ENTRY).groupBy("rel_path").agg(newest).select("rel_path", "e.*")

    def commit(self, files: DataFrame, rows: DataFrame, gen: str) -> None:
        """Make both tables visible as generation ``gen``, or neither. What a dead writer left is not read."""
        draft = f".draft-{uuid.uuid4().hex}"
        files.select("rel_path", "lang", "stat", "hash", "rows_gen", F.lit(gen).alias("gen")).write.parquet(f"{self.root}/{draft}/files")
        rows.select("rel_path", "tag_ord", "name", "file_name", "address", "kind", "fields", F.lit(gen).alias("gen")).write.parquet(f"{self.root}/{draft}/rows")
        source, fs = self._path(draft)
        if not fs.rename(source, self._path(gen)[0]):
            raise OSError(f"{self.root}/{gen} cannot be committed")

    def next_name(self) -> str:
        last = max((int(g.split("-")[1]) for g in self.generations()), default=0)
        return f"gen-{last + 1:010d}-{uuid.uuid4().hex[:8]}"  # no two writers take one name

    def compact(self) -> None:
        """One generation in place of all: the newest entries and the rows that they point to."""
        old, gen = self.generations(), self.next_name()
        entries = written(self.entries(), "entries")
        rows = self._tables("rows", ROWS).join(entries.select("rel_path", F.col("rows_gen").alias("gen")), ["rel_path", "gen"], "left_semi")
        self.commit(entries.withColumn("rows_gen", F.lit(gen)), rows, gen)
        for name in old:
            path, fs = self._path(name)
            fs.delete(path, True)

    def extract(self, files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of EXTRACTED for all ``files`` (distinct rel_path, lang, file_ord, content or path, perhaps stat).

        ``extract`` is called with the files that changed. A file that gave an error is not
        kept, so the next run tries it again.
        """
        if "stat" not in files.columns:
            files = files.withColumn("stat", F.lit(None).cast("string"))
        if len(self.generations()) > GENERATIONS:
            self.compact()
        entries, own = written(self.entries(), "entries"), files.columns
        found = files.filter("lang is not null")
        known = entries.select("rel_path", "lang", F.col("stat").alias("was"), F.col("hash").alias("had"), "rows_gen")
        joined = found.join(known, ["rel_path", "lang"], "left")
        seen = written(joined.filter("stat = was").select("rel_path", "file_ord", "rows_gen"), "seen")
        rest = joined.filter("stat is null or was is null or stat <> was").select(*own, "had", "rows_gen")
        hashes = written(content_hash(rest), "hashes")
        rest = rest.join(hashes, "rel_path")
        same = written(rest.filter("hash = had").select("rel_path", "lang", "stat", "hash", "rows_gen", "file_ord"), "same")
        changed = rest.filter("hash is null or had is null or hash <> had")
        fresh = written(extract(changed.select(*own)), "fresh")
        gen = self.next_name()
        named = written(changed.select("rel_path", "lang", "stat", "hash", "file_ord"), "changed")
        bad = fresh.filter("error is not null").select("file_ord").distinct()
        good = named.filter("hash is not null").join(bad, "file_ord", "left_anti").withColumn("rows_gen", F.lit(gen))
        again = good.unionByName(same)
        if not again.isEmpty():
            rows = fresh.filter("error is null").join(good.select("file_ord", "rel_path"), "file_ord")
            self.commit(again, rows, gen)
        kept = seen.unionByName(same.select("rel_path", "file_ord", "rows_gen")).withColumnRenamed("rows_gen", "gen")
        old = self._tables("rows", ROWS).join(kept, ["rel_path", "gen"]).withColumn("error", F.lit(None).cast("string"))
        columns = [f.name for f in EXTRACTED.fields]
        return fresh.select(*columns).unionByName(old.select(*columns))
