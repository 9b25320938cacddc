"""Tree patterns as joins over a table of nodes.

A pattern node is a filter on the node table; a child is an equi-join on (file, parent); an
alternation is a union, an optional child a left join, an absent field an anti join, and
predicates are filters on captured texts. So a query runs over all files at once, and no
file's tree is held anywhere but in the task that made it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.base import split_lines
from ..extract.tree import DECLARATIONS, nodes_of, type_regex
from ..plans.patterns import Pattern, captures_of

NODES = "file long, lang string, id int, parent int, place int, type string, field string, text string, row int, address string"
NODES_ARROW = pa.schema([("file", pa.int64()), ("lang", pa.string()), ("id", pa.int32()), ("parent", pa.int32()), ("place", pa.int32()), ("type", pa.string()), ("field", pa.string()), ("text", pa.string()), ("row", pa.int32()), ("address", pa.string())])
#: Leaves' texts are kept up to so many characters; predicates on longer ones see their beginning.
TEXT_CHARS = 4_096
BATCH_NODES = 50_000


def node_table(files: DataFrame) -> DataFrame:
    """The nodes of every file: columns file_ord, lang, and content or the path to read.

    A file that cannot be read or is not UTF-8 has one node, number -1, of type ``error``, with what went wrong as its text.
    Files without a language that has trees have none.
    """
    from .extract import address  # which reads this module

    body = F.col("content").cast("binary") if "content" in files.columns else F.lit(None).cast("binary")
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    rows = files.filter(F.col("lang").isin(*DECLARATIONS)).select(F.col("file_ord").cast("long").alias("file"), "lang", body.alias("content"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                try:
                    data = r["content"]
                    if data is None:
                        with open(r["path"], "rb") as f:
                            data = f.read()
                    text = data.decode("utf-8")
                except (OSError, TypeError, UnicodeDecodeError) as e:
                    out.append((r["file"], r["lang"], -1, -1, 0, "error", "", f"{type(e).__name__}: {e}", 0, None))
                    continue
                lines, shown = split_lines(text), {}
                for i, parent, place, kind, field, leaf, row in nodes_of(text, r["lang"]):
                    if kind == "identifier" and row not in shown:
                        shown = {row: address(lines, row, "query")}  # nodes come in order of rows
                    out.append((r["file"], r["lang"], i, parent, place, kind, field, leaf[:TEXT_CHARS], row, shown[row] if kind == "identifier" else None))
                    if len(out) >= BATCH_NODES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODES_ARROW)], schema=NODES_ARROW)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODES_ARROW)], schema=NODES_ARROW)

    return rows.mapInArrow(run, NODES)


CAPTURE = "struct<id:int,text:string,row:int,address:string>"


def _kind(p: Pattern) -> Column:
    if p.type is None:
        return F.lit(True)
    if p.token:
        return (F.col("type") == p.type) | (F.col("text") == p.type)
    family = type_regex(p.type)
    return (F.col("type") == p.type) | (F.col("type") == family) if family else F.col("type") == p.type


def _predicate(name: str, args: tuple[str, ...], names: list[str]) -> Column | None:
    if not args or not args[0].startswith("@") or args[0][1:] not in names:
        return None
    one = F.col(f"`@{args[0][1:]}`.text")
    if name in ("#eq?", "#not-eq?") and len(args) == 2:
        other = F.col(f"`@{args[1][1:]}`.text") if args[1].startswith("@") and args[1][1:] in names else F.lit(args[1])
        return one.eqNullSafe(other) if name == "#eq?" else ~one.eqNullSafe(other)
    if name in ("#match?", "#not-match?") and len(args) == 2:
        return F.coalesce(one.rlike(args[1]), F.lit(False)) if name == "#match?" else ~F.coalesce(one.rlike(args[1]), F.lit(False))
    if name == "#any-of?":
        return F.coalesce(one.isin(*args[1:]), F.lit(False))
    return None


def bare(p: Pattern) -> bool:
    """Whether a pattern says no more of its own node than that it has a first child."""
    return not (p.options or p.type is not None or p.field or p.captures) and bool(p.children) and p.children[0].quantifier not in ("?", "*")


def _child(nodes: DataFrame, child: Pattern) -> DataFrame:
    """Rows of a child's pattern: f, p and q for file, parent and place, and its captures."""
    inner = _matches(nodes, child)
    if child.closes:
        last = nodes.groupBy("file", "parent").agg(F.max("place").alias("place"))
        inner = inner.join(last, ["file", "parent", "place"], "left_semi")
    names = [c for c in inner.columns if c.startswith("@")]
    return inner.select(F.col("file").alias("f"), F.col("parent").alias("p"), F.col("place").alias("q"), *(F.col(f"`{c}`") for c in names))


def _matches(nodes: DataFrame, p: Pattern, top: bool = False) -> DataFrame:
    """file, id, parent, place and a struct column ``@name`` for each capture: a row for each way the pattern holds.

    A pattern at the ``top`` needs file, id and captures only.
    """
    if p.options:
        names = captures_of(p)
        some = []
        for option in p.options:
            found = _matches(nodes, option)
            some.append(found.select("file", "id", "parent", "place", "field", *(F.col(f"`@{n}`") if f"@{n}" in found.columns else F.lit(None).cast(CAPTURE).alias(f"@{n}") for n in names if n not in p.captures)))
        out = reduce(DataFrame.unionByName, some).distinct()
        if p.captures:
            facts = nodes.select("file", "id", F.struct("id", "text", "row", "address").cast(CAPTURE).alias("fact"))
            out = out.join(facts, ["file", "id"])
            out = out.select(*(c for c in out.columns if c != "fact"), *(F.col("fact").alias(f"@{c}") for c in p.captures))
    else:
        out = nodes.filter(_kind(p)).select("file", "id", "parent", "place", "field", *(F.struct("id", "text", "row", "address").cast(CAPTURE).alias(f"@{c}") for c in p.captures))
    if p.field:
        out = out.filter(F.col("field") == p.field)
    children = p.children
    if top and bare(p):
        # any node will do, so the rows of its first child name it: no join with all nodes
        first, children = _child(nodes, children[0]), children[1:]
        first = first.filter("q = 0") if p.children[0].adjoins else first
        out = first.filter("p >= 0").withColumnsRenamed({"f": "file", "p": "id", "q": "at"})
    else:
        out = out.withColumn("at", F.lit(-1))
    for absent in p.absent:
        taken = nodes.filter(F.col("field") == absent).select("file", F.col("parent").alias("id"))
        out = out.join(taken, ["file", "id"], "left_anti")
    for child in children:
        inner = _child(nodes, child)
        here = F.col("q") == F.col("at") + 1 if child.adjoins else F.col("q") > F.col("at")
        joined = out.join(inner, (F.col("file") == F.col("f")) & (F.col("id") == F.col("p")) & here, "left" if child.quantifier in ("?", "*") else "inner")
        out = joined.withColumn("at", F.coalesce("q", "at")).drop("f", "p", "q")
    names = captures_of(p)
    for name, *args in p.predicates:
        held = _predicate(name, tuple(args), names)
        out = out.filter(held) if held is not None else out
    return out.drop("at")


def match(nodes: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """file, pattern (its number), id and captures (an array of name, text, row, address): a row for each match.

    ``nodes`` should be written, as each pattern reads it once for each of its nodes.
    """
    shape = "array<struct<name:string,id:int,text:string,row:int,address:string>>"
    nodes, some = nodes.filter("id >= 0"), []
    for number, p in enumerate(patterns):
        found = _matches(nodes, p, top=True)
        pairs = [F.when(F.col(f"`@{n}`").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"`@{n}`.id").alias("id"), F.col(f"`@{n}`.text").alias("text"), F.col(f"`@{n}`.row").alias("row"), F.col(f"`@{n}`.address").alias("address"))) for n in captures_of(p)]
        captures = F.array_compact(F.array(*pairs)) if pairs else F.array()
        some.append(found.select("file", F.lit(number).alias("pattern"), "id", captures.cast(shape).alias("captures")))
    return reduce(DataFrame.unionByName, some)


def definitions(nodes: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """file, id, name, row, address of what patterns with a ``@definition...`` capture name; a name at one place is one row."""
    wanted = [p for p in patterns if any(c.startswith("definition") for c in captures_of(p)) and "name" in captures_of(p)]
    if not wanted:
        return nodes.select("file", "id", F.col("text").alias("name"), "row", "address").limit(0)
    named = match(nodes, wanted).select("file", F.explode("captures").alias("c")).filter("c.name = 'name'")
    return named.select("file", "c.id", F.col("c.text").alias("name"), "c.row", "c.address").distinct()
