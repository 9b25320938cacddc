"""Mixing sources to target weights.

1. A source's words, in a fixed order of its documents, are packed into blocks of one length.
2. Targets follow the weights, none above ``most`` times its source; a source's target is so
   many slots of a block each.
3. Slots are drawn over the output shards by a multinomial for each source, first over groups
   of shards, then inside each group; a shard's counts are thus multinomial, given its size,
   while each source's total is exact.
4. Slot j of a source of N blocks is in pass j div N and takes the block that a pseudorandom
   permutation of the pass gives for j mod N, so a block is taken once in each whole pass.
5. Slots and blocks are joined by block number.

What is shuffled are spans (a document, a first word, a length) and never the texts;
``shard_texts`` fetches the words of a mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import U64, mix as scramble
from .workspace import Workspace, quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; a source of fewer than BLOCK * FINE words has shorter ones, so that rounding a target to whole blocks costs little.
BLOCK = 64
FINE = 256
SHARD_SLOTS = 8_192
GROUP_SHARDS = 1_024


def cycled(weights: Sequence[float]):
    """Weights that repeat along the sources in their order by code point, null last."""
    return lambda rank: F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))


def _level(sources: DataFrame, most: float, share: float) -> float | None:
    """Words for each unit of weight, once what capped sources cannot take is dealt among the others; None: all are capped.

    Each round is one aggregation and caps at least one source more; the level only rises.
    """
    level = None
    while True:
        capped = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
        r = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(capped, F.lit(most) * F.col("source_size")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not r["words"] or not r["open"]:
            return 0.0 if not r["words"] else None
        now = (share * r["words"] - r["fixed"]) / r["open"]
        if level is not None and now <= level:
            return level
        level = now


def _spread(rng: np.random.Generator, slots: int, sizes: np.ndarray) -> np.ndarray:
    return rng.multinomial(slots, sizes / sizes.sum())


def _draw(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """sid, blocks, shard, first, count: slots first to first + count - 1 of a source lie in that shard."""
    groups = -(-shards // GROUP_SHARDS)
    schema = "sid long, blocks long, shard long, first long, count long"

    def dealt(level: int, parts):
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    ids, sizes = parts(r)
                    counts = _spread(np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, level, r["sid"], r["shard"]]))), r["count"], sizes)
                    firsts = r["first"] + np.cumsum(counts) - counts
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r["sid"])), pa.array(np.full(len(some), r["blocks"])), pa.array(ids[some]), pa.array(firsts[some]), pa.array(counts[some])], ["sid", "blocks", "shard", "first", "count"])

        return run

    def to_groups(_):
        at = np.arange(groups, dtype=np.int64)
        return at, np.minimum(GROUP_SHARDS, shards - at * GROUP_SHARDS)

    def to_shards(r):
        at = np.arange(r["shard"] * GROUP_SHARDS, min(shards, (r["shard"] + 1) * GROUP_SHARDS), dtype=np.int64)
        return at, np.ones(len(at))

    start = sources.filter("slots > 0").select("sid", "blocks", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("slots").alias("count"))
    return start.mapInArrow(dealt(0, to_groups), schema).repartition("sid", "shard").mapInArrow(dealt(1, to_shards), schema)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key: four rounds of a Feistel network, walked on until inside."""
    half = np.ceil(np.log2(np.maximum(size, 4).astype(np.float64)) / 2).astype(U64)
    low, key = (U64(1) << half) - U64(1), key.astype(U64)
    out, todo = index.astype(U64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (scramble(right + scramble(k + U64(r + 1))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(U64)]
    return out.astype(np.int64)


def _slots(draws: DataFrame, seed: int) -> DataFrame:
    """sid, block, shard, slot, pass of every slot."""

    def run(batches):
        for batch in batches:
            sid, blocks, shard, slot = (np.asarray(batch.column(c)) for c in ("sid", "blocks", "shard", "slot"))
            turn = slot // blocks
            key = scramble(sid.astype(U64) * U64(0x9E3779B97F4A7C15) + scramble(turn.astype(U64) + U64(seed)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sid, permuted(slot % blocks, blocks, key), shard, slot, turn)], ["sid", "block", "shard", "slot", "pass"])

    # a shard's slots are few; they are numbered in the task of their shard
    every = draws.repartition("shard").select("sid", "blocks", "shard", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("slot"))
    return every.mapInArrow(run, "sid long, block long, shard long, slot long, pass long")


class Mix:
    """``documents``: a row for each row of the input (key columns, id, source, size, sid, source_size, target).
    ``sources``: sid, source, source_size, weight, target, length (words of a block), blocks, slots.
    ``spans``: shard, slot, sid, pass, block, place (in the block), key columns, start, length (words).
    """

    def __init__(self, documents: DataFrame, sources: DataFrame, spans: DataFrame):
        self.documents, self.sources, self.spans = documents, sources, spans


def mix(docs: DataFrame, weigh, key: list[str], space: Workspace, seed: int = 12, most: float = 3.0, share: float = 1.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Mix:
    """Mix all rows of ``docs``. ``weigh`` gives a source's weight from its rank by code point (null last); weights are positive.

    ``key`` names columns that tell rows apart and are never null; they come out as k0, k1 ...
    Documents are packed in the order of source, id and key, whatever the partitions, so a
    second run agrees. Null texts count as empty; a null source is one like any other; null
    and repeated ids are rows each for themselves. Sources without words, and empty tables,
    give no spans. Other columns are not read.
    """
    keys = [f"k{i}" for i in range(len(key))]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    sizes = space.write(docs.select(*(F.col(quoted(c)).alias(k) for c, k in zip(key, keys)), F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order: list[Column] = [F.asc_nulls_last("source"), F.asc_nulls_last("id"), *(F.asc(k) for k in keys)]
    # by range, so that a hot source is dealt like any rows and a source's words are counted range by range
    dealt = space.write(sizes.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "dealt")
    parts = space.write(dealt.groupBy("range", "source").agg(F.sum("size").alias("words")), "parts")
    named = parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.min("range").alias("range"))
    # a source's rank: those that begin in earlier ranges (a row a range comes to the driver), and those before it in its own
    begun = named.groupBy("range").count().orderBy("range").collect()
    before, total = [], 0
    for r in begun:
        before.append((r["range"], total))
        total += r["count"]
    firsts = docs.sparkSession.createDataFrame(before, "range int, ahead long")
    sid = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) - 1
    ranked = space.write(named.join(F.broadcast(firsts), "range").select("source", "source_size", sid.alias("sid")).withColumn("weight", weigh(F.col("sid"))), "ranked")
    level = _level(ranked, most, share)
    cap = F.lit(float(most)) * F.col("source_size")
    sources = ranked.withColumn("target", cap if level is None else F.least(F.lit(level) * F.col("weight"), cap))
    sources = sources.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {FINE}"))).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round((F.col("target") - passes * F.col("source_size")) / F.col("length")).cast("long")
    sources = space.write(sources.withColumn("slots", passes * F.col("blocks") + F.least(rest, F.col("blocks"))), "sources")
    slots = sources.agg(F.sum("slots")).first()[0] or 0
    drawn = _slots(_draw(sources, max(1, math.ceil(slots / shard_slots)), seed), seed)
    # where a source's words begin in each range: at most a row for each range and source
    base = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    starts = parts.select("range", F.col("source").alias("s"), base.alias("base")).join(sources.withColumnRenamed("source", "name"), F.col("s").eqNullSafe(F.col("name")))
    starts = space.write(starts.select(F.col("range").alias("r"), "s", "base", "sid", "source_size", "target", F.col("length").alias("words")), "starts")
    # joined by range and source, so that no source is hot
    placed = dealt.join(starts, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    inside = F.sum("size").over(Window.partitionBy("range", "source").orderBy(*order[1:])) - F.col("size")
    at = placed.filter("size > 0").withColumn("at", F.col("base") + inside)
    numbers = F.sequence(F.expr("at div words"), F.expr("(at + size - 1) div words"))
    cut = at.select(*keys, "sid", "at", "size", "words", F.explode(numbers).alias("block")).withColumn("from", F.greatest(F.lit(0), F.expr("block * words - at")))
    pieces = cut.select("sid", "block", F.expr("at + from - block * words").alias("place"), *keys, F.col("from").alias("start"), F.expr("least(size, (block + 1) * words - at) - from").alias("length"))
    # merged, as sizes guessed from the sources' few rows would have all slots broadcast
    spans = drawn.hint("merge").join(pieces, ["sid", "block"]).select("shard", "slot", "sid", "pass", "block", "place", *keys, "start", "length")
    return Mix(placed.select(*keys, "id", "source", "size", "sid", "source_size", "target"), sources, spans)


def shard_texts(made: DataFrame, docs: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """shard, slot, sid, text: the words of each slot's block, joined by one space. ``made`` are the spans of a mix of ``docs``.

    A document's spans are gathered first, at most its words divided by the block's, times the
    passes; so each text is split once.
    """
    keys = [f"k{i}" for i in range(len(key))]
    wanted = made.groupBy(*keys).agg(F.collect_list(F.struct("shard", "slot", "sid", "place", "start", "length")).alias("spans"))
    words = F.regexp_extract_all(F.coalesce(F.col(quoted(text_col)), F.lit("")), F.lit(WORD), 0)
    cut = lambda w: F.transform("spans", lambda s: F.struct(s["shard"].alias("shard"), s["sid"].alias("sid"), s["slot"].alias("slot"), s["place"].alias("place"), F.array_join(F.slice(w, (s["start"] + 1).cast("int"), s["length"].cast("int")), " ").alias("part")))
    # the words are an argument of a function, so that they are split once and not for each span
    parts = docs.select(*(F.col(quoted(c)).alias(k) for c, k in zip(key, keys)), words.alias("words")).join(wanted, keys)
    split = parts.select(F.explode(F.flatten(F.transform(F.array("words"), cut))).alias("s")).select("s.*")
    gathered = split.groupBy("shard", "sid", "slot").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return gathered.select("shard", "slot", "sid", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"))
