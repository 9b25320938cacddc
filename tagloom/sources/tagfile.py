"""Tags files: one line a tag below a header, read, checked and written."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.tags import header, in_file_order, parse_lines, render, sort_tags, valid_tags_file


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def is_tags_file(spark: SparkSession, path: str) -> bool:
    """Whether an existing file may be overwritten as a tags file; an empty one may."""
    return bool(valid_tags_file(spark.read.text(path)).first()["valid"])


def output_path(name: str, cwd: str = ".") -> str:
    """``-`` is standard output; other names that begin with a dash are refused."""
    if name != "-" and name.startswith("-"):
        raise ValueError(f"tag file name may not begin with a dash: {name}")
    return name if name == "-" or os.path.isabs(name) else os.path.join(cwd, name)


def tag_lines(tags: DataFrame, is_sorted: bool = True) -> DataFrame:
    """Rendered lines in order."""
    ordered = sort_tags(tags) if is_sorted else in_file_order(tags) if "tag_ord" in tags.columns else tags
    return render(ordered).select("value")


def _write(lines: Iterable[str], out) -> None:
    for line in lines:
        out.write(line + "\n")


def write_tags(tags: DataFrame, path: str, is_sorted: bool = True) -> None:
    """Header and lines to one file, partition by partition. The file is replaced at the end, so its old self may be read meanwhile."""
    rows = (r["value"] for r in tag_lines(tags, is_sorted).toLocalIterator())
    if path == "-":
        _write([header(is_sorted)], sys.stdout)
        _write(rows, sys.stdout)
        return
    draft = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(draft, "w", encoding="utf-8", newline="") as out:
        _write([header(is_sorted)], out)
        _write(rows, out)
    os.replace(draft, path)


def write_tags_distributed(tags: DataFrame, folder: str, is_sorted: bool = True) -> None:
    """Header and lines as text parts whose names are in order, for results too large for one file.

    Executors write the parts into a draft, which takes the folder's place by a rename once it
    is whole; what was there goes after that, so a run that fails leaves the old tags.
    """
    spark, folder = tags.sparkSession, folder.rstrip("/")
    top = spark.createDataFrame([(header(is_sorted),)], "value string").coalesce(1)
    draft, old = (f"{folder}.{kind}-{uuid.uuid4().hex[:8]}" for kind in ("draft", "old"))
    # partitions of a union stand one behind the other, and parts are named by partition
    top.union(tag_lines(tags, is_sorted)).write.text(draft)
    place = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = place(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    had = fs.exists(place(folder))
    if had and not fs.rename(place(folder), place(old)):
        raise OSError(f"{folder} cannot be moved away")
    if not fs.rename(place(draft), place(folder)):
        if had:
            fs.rename(place(old), place(folder))
        raise OSError(f"{folder} cannot be put in place")
    if had:
        fs.delete(place(old), True)
