"""Finding and reading source files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import exclude_regex
from ..session import written
from . import storage

#: What resolution looks at: marks of C++ in so many first bytes, mode lines in as many last ones.
HEAD, ENDS = 8192, 4096
READ_BYTES = 4 << 20
#: Entries that a task walks on below the folders it was given; deeper folders are dealt anew.
AHEAD = 20_000
#: Rows that a listing task sends at once.
LISTED_ROWS = 4096
#: Source bytes that one task extracts, about.
TASK_BYTES = 256 << 20

#: A path on the way: ``given`` is the argument it lies below, ``shown`` its name as the user wrote it; a folder has yet to be listed.
LISTED = T.StructType(
    [
        T.StructField("given", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("shown", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("is_folder", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("is_exec", T.BooleanType()),
        T.StructField("stat", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _lister(excludes: list[str], recurse: bool, base: str, ahead: int):
    """The task of ``discover``: rows of arguments (``is_folder`` null) and of folders become rows of files, errors and deeper folders."""
    patterns = [exclude_regex(p) for p in excludes]
    names = LISTED.fieldNames()

    def rows(given: int, path: str, shown: str, is_argument: bool, budget: list[int]) -> Iterator[tuple]:
        failed = lambda name, why: (given, None, name, None, False, None, None, None, f"{name}: {why}")
        found = lambda here, name, e: (given, here, name, relative(name, base), False, e.size, e.is_exec, e.stat, None)
        if is_argument:
            try:
                e = storage.entry(path)
            except OSError:
                yield failed(shown, "no such file")
                return
            if not e.is_folder:
                # excludes do not apply to what is named
                yield found(path, shown, e) if e.is_file else failed(shown, "no such file")
                return
            if not recurse:
                yield failed(shown, "is a directory")
                return
        skip = [re.compile(p) for p in patterns]
        stack, first = [(path, shown)], True
        while stack:
            here, name = stack.pop()
            if not first and budget[0] <= 0:
                yield given, here, name, None, True, None, None, None, None
                continue
            first = False
            try:
                for e in storage.entries(here):
                    budget[0] -= 1
                    below = os.path.join(name, e.name)
                    try:
                        below.encode("utf-8")
                    except UnicodeEncodeError:
                        yield failed(repr(below), "not UTF-8")
                        continue
                    if e.is_folder:
                        stack.append((os.path.join(here, e.name), below))
                    elif e.is_file and not any(x.search(below) for x in skip):
                        yield found(os.path.join(here, e.name), below, e)
            except OSError as e:
                yield failed(name, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget, out = [ahead], []
        types = [pa.int64(), *[pa.string()] * 3, pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        for batch in batches:
            for given, path, shown, is_folder in zip(*(batch.column(c).to_pylist() for c in ("given", "path", "shown", "is_folder"))):
                for row in rows(given, path, shown, is_folder is None, budget):
                    out.append(row)
                    if len(out) == LISTED_ROWS:
                        yield made()
                        out = []
        if out:
            yield made()

    return run


def discover(spark: SparkSession, paths: list[str], excludes: list[str] = (), recurse: bool = True, base: str = ".", ahead: int = AHEAD) -> tuple[DataFrame, DataFrame]:
    """Files (FILE) and errors (``error``, in order) of paths or URIs of files and folders; partial failure is normal.

    Executors look at the arguments, list folders and stat what lies in them. A task walks on
    below its folders for ``ahead`` entries; what lies deeper is dealt to tasks by hash in the
    next round, so a small tree takes one round and a large one is spread, however uneven.
    Folders stay rows of a table: the driver sees their number only.

    Files as given (excludes do not apply to them, nor is a file given twice one); folders are
    scanned, hidden files too; an excluded folder is still entered; links are not followed.
    ``file_ord`` follows the arguments and then the names, and has gaps.
    """
    paths = list(paths) or ["."]
    places = [p if storage.is_remote(p) else os.path.abspath(storage.local(p)) for p in paths]
    base = base if storage.is_remote(base) else os.path.abspath(storage.local(base))
    run = _lister(list(excludes), recurse, base, ahead)
    level = spark.createDataFrame([(i, at, storage.local(p), None) for i, (p, at) in enumerate(zip(paths, places))], "given long, path string, shown string, is_folder boolean")
    most, left, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), len(paths), []
    while left:
        level = written(level.repartition(min(left, most), "path").mapInArrow(run, LISTED), "listed")
        rounds.append(level)
        level = level.filter("is_folder").select("given", "path", "shown", "is_folder")
        left = level.count()
    rows = reduce(DataFrame.unionByName, rounds).orderBy("given", "shown")
    files = rows.filter("error is null and not is_folder").withColumn("file_ord", F.monotonically_increasing_id())
    return written(files.select("path", "rel_path", "file_ord", "size", "is_exec", "stat"), "files"), rows.filter("error is not null").select("error")


def relative(path: str, base: str) -> str:
    """The path below the tags file's folder where it lies there, else as given, without a leading ``./``."""
    if storage.is_remote(path):
        return path.removeprefix(base.rstrip("/") + "/")
    full, root = os.path.abspath(path), os.path.abspath(base)
    if os.path.isabs(path) and full.startswith(root.rstrip("/") + "/"):
        return full[len(root.rstrip("/")) + 1 :]
    return path[2:] if path.startswith("./") else path


def files_table(spark: SparkSession, paths: list[str], base: str = ".") -> DataFrame:
    """FILE rows of paths: names and facts about them, not their content."""
    return discover(spark, paths, recurse=False, base=base)[0]


def balanced(files: DataFrame, tasks: int) -> DataFrame:
    """Deal files to tasks by size: in every range of sizes they go round, so no task gets all the large ones.

    There are at least ``tasks`` tasks, and one for each TASK_BYTES.
    """
    size = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(tasks, -(-size // TASK_BYTES))
    placed = files.orderBy(F.desc("size"), "file_ord").withColumn("_slot", (F.monotonically_increasing_id() % tasks).cast("int"))
    return placed.repartitionById(tasks, F.col("_slot")).drop("_slot")


def read_ends(files: DataFrame, ask: str) -> DataFrame:
    """``content`` of the rows whose ``ask`` column is true, as far as resolution looks: HEAD bytes and the last ENDS.

    Null for other rows, and for what cannot be read. The executors read, a file at a time,
    and send READ_BYTES at most at once.
    """
    kept = [f for f in files.schema.fields if f.name != ask]
    schema = T.StructType([*kept, T.StructField("content", T.BinaryType())])

    def ends(path: str) -> bytes | None:
        try:
            with storage.opened(path) as f:
                head = f.read(HEAD)
                size = f.seek(0, os.SEEK_END)
                f.seek(max(len(head), size - ENDS))
                return head + f.read(ENDS)
        except OSError:
            return None

    def run(batches):
        for batch in batches:
            done, found, held = 0, [], 0
            for i, (path, wanted) in enumerate(zip(batch["path"], batch[ask])):
                found.append(ends(path) if wanted else None)
                held += len(found[-1] or b"")
                if held >= READ_BYTES or i + 1 == len(batch):
                    yield batch.iloc[done : i + 1].drop(columns=ask).assign(content=found)
                    done, found, held = i + 1, [], 0

    return files.mapInPandas(run, schema)
