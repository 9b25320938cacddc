"""Connected components of a link table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(links: DataFrame, space: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the least node it reaches.

    Alternating large-star and small-star steps: a star's centre is the least
    neighbour, so a hub's links are combined before the shuffle and the number of
    rounds grows with the logarithm of the longest path. Each round is written to
    the shared folder. Null and self links are dropped; no links give no rows.
    """
    pairs = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = space.write(pairs, f"{name}_0")
    turn, before = 0, None
    while True:
        # large star: every larger neighbour of u is joined to the least of u's neighbourhood
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are joined to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        turn += 1
        after = space.write(small, f"{name}_{turn}")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        space.drop(f"{name}_{turn - 1}")
        pairs = after
        if now == before or not now[0]:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
