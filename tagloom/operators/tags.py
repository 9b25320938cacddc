"""Relational operators on tags: render, parse, select, unite and sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

UNSCOPED = ("line", "end", "kind", "file", "signature", "access")


def _has(fields: Column, key: str) -> Column:
    return F.coalesce(F.exists(fields, lambda f: f["key"] == key), F.lit(False))


def rendered_fields(fields: Column) -> Column:
    """``key:value`` strings. ``module`` is printed only alone; else its value prefixes the others' but for UNSCOPED keys."""
    only_module = (F.size(fields) == 1) & _has(fields, "module")
    module = F.try_element_at(F.transform(F.filter(fields, lambda f: f["key"] == "module"), lambda f: f["value"]), F.lit(1))
    joined = lambda f: F.concat(f["key"], F.lit(":"), f["value"])
    scoped = lambda f: F.when(f["key"].isin(*UNSCOPED), joined(f)).otherwise(F.concat(f["key"], F.lit(":"), module, F.lit("::"), f["value"]))
    rest = F.filter(fields, lambda f: f["key"] != "module")
    return F.when(fields.isNull(), F.array().cast("array<string>")).when(~_has(fields, "module") | only_module, F.transform(fields, joined)).otherwise(F.transform(rest, scoped))


def render(tags: DataFrame) -> DataFrame:
    """One ``value`` line a tag: name, file, address, the kind unless a field shows it, and the fields."""
    kind = F.when(F.col("kind").isNotNull() & ~_has(F.col("fields"), "kind"), F.array("kind")).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array("name", "file_name", "address"), kind, rendered_fields(F.col("fields")))
    return tags.select(*(c for c in tags.columns if c not in ("name", "file_name", "address", "kind", "fields")), F.array_join(parts, "\t").alias("value"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tags of the lines of a tags file; comment lines and lines of fewer than three parts are dropped.

    The address keeps a tab at its end. ``kind:`` sets the kind, as does the first part
    without a colon if none is set.
    """
    parts = F.split(column, "\t")
    rest = F.filter(F.transform(F.slice(parts, F.lit(4), F.greatest(F.size(parts), F.lit(4))), lambda p: F.trim(p)), lambda p: p != "")
    keyed = F.filter(rest, lambda p: p.contains(":"))
    explicit = F.filter(keyed, lambda p: p.startswith("kind:"))
    bare = F.try_element_at(F.filter(rest, lambda p: ~p.contains(":")), F.lit(1))
    key = lambda p: F.substring_index(p, ":", 1)
    value = lambda p: p.substr(F.locate(":", p) + 1, F.length(p))
    fields = F.transform(F.filter(keyed, lambda p: ~p.startswith("kind:")), lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))
    kind = F.coalesce(value(F.try_element_at(explicit, F.lit(-1))), bare)
    rows = lines.filter(~F.col(column).startswith("!") & (F.size(parts) >= 3))
    return rows.select(
        F.element_at(parts, 1).alias("name"),
        F.element_at(parts, 2).alias("file_name"),
        F.concat(F.element_at(parts, 3), F.lit("\t")).alias("address"),
        kind.alias("kind"),
        F.when(F.size(fields) > 0, fields).alias("fields"),
    )


def valid_tags_file(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row, ``valid``: the first line that is not blank is a header or has three parts; no such line is valid."""
    first = lines.filter(F.trim(column) != "").limit(1)
    good = F.col(column).startswith("!_TAG_") | (F.size(F.split(column, "\t")) >= 3)
    return first.agg(F.coalesce(F.bool_and(good), F.lit(True)).alias("valid"))


def sort_tags(tags: DataFrame) -> DataFrame:
    """Name, file, address, kind and fields in byte order, absent values first: a range partition and a local sort."""
    return tags.orderBy("name", "file_name", "address", F.col("kind").asc_nulls_first(), F.col("fields").asc_nulls_first())


SORT_KEY = ("name", "file_name", "address", "kind", "fields")


def ranked(tags: DataFrame) -> DataFrame:
    """All columns and ``rank``, the place from 1 in the order of ``sort_tags``.

    Rows are dealt by range of the whole sort key and written; each range is counted, and a
    row's place inside its range is added to the counts of those before. Bounds are Spark's
    own and no part of the plan. Equal rows lie in one range, in any order. No rows give no
    rows.
    """
    spark = tags.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*SORT_KEY[:3], F.col("kind").asc_nulls_first(), F.col("fields").asc_nulls_first()]
    dealt = written(tags.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    # a row a range
    ahead = dealt.groupBy("range").agg(F.count("*").alias("size"))
    ahead = ahead.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(F.broadcast(ahead), "range")
    return placed.select(*tags.columns, (F.col("ahead") + F.col("place")).cast("long").alias("rank"))


def in_file_order(tags: DataFrame) -> DataFrame:
    return tags.orderBy("file_ord", "tag_ord")


def append(new: DataFrame, old: DataFrame) -> DataFrame:
    """All of both: no row is a duplicate, none goes stale."""
    columns = ["name", "file_name", "address", "kind", "fields"]
    return new.select(*columns).unionByName(old.select(*columns))


def keep_kinds(tags: DataFrame, kinds: list[str]) -> DataFrame:
    return tags.filter(F.array_contains(F.array(*(F.lit(k) for k in kinds)), F.col("kind")) if kinds else F.lit(False))


def drop_placeholders(tags: DataFrame, names: tuple[str, ...] = ("", "_")) -> DataFrame:
    return tags.filter(~F.col("name").isin(*names))


def pick_fields(fields: Column, enabled: list[str]) -> Column:
    return F.filter(fields, lambda f: f["key"].isin(*enabled))


def put_field(fields: Column, key: str, value: Column) -> Column:
    """Set a field: in its place where the key exists, else at the end."""
    new = F.struct(F.lit(key).alias("key"), value.alias("value"))
    return F.when(_has(fields, key), F.transform(fields, lambda f: F.when(f["key"] == key, new).otherwise(f))).otherwise(F.concat(F.coalesce(fields, F.array().cast("array<struct<key:string,value:string>>")), F.array(new)))


def header(is_sorted: bool) -> str:
    return f"!_TAG_FILE_SORTED\t{int(is_sorted)}\t/0=unsorted, 1=sorted/"
