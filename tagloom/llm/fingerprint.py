"""Canonical exact digests of documents, with DataFrame functions only.

A text's canonical form is its NFKC normal form, case-folded, with runs of white
space made one space and the ends trimmed. Its digest is 128 bits wide: two
differently seeded xxhash64 values. Texts of equal digest form a bucket; inside a
bucket canonical bytes are compared, and where they differ (a collision) the digest
is extended by the SHA-256 of the bytes, so that equal fingerprints mean equal
canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, free_name


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty. Normalisation and case folding are the JVM's Unicode library's."""
    whole = F.coalesce(text, F.lit(""))
    plain = whole.rlike(r"^[\x00-\x7F]*$")
    normal = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), whole, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal, F.lit(True))
    again = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(F.when(plain, F.lower(whole)).otherwise(again), r"[\s\p{Z}\u0085​﻿]+", " "))


def digest(canon: Column) -> Column:
    """128 bits in hex."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


#: Bits of the filter that keeps rows of single buckets out of a shuffle; its size is fixed.
FILTER_BITS = 1 << 24


def _slot(ids: list[str]) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(FILTER_BITS))


def only(rows: DataFrame, ids: DataFrame, id_cols: list[str]) -> DataFrame:
    """The rows whose id_cols (nulls included) are in ``ids``, most others being dropped before the shuffle.

    ``ids`` is hashed into a bitmap of FILTER_BITS (2 MB, whatever its length), which is
    broadcast; an exact join follows. That is an inner join, as a semi join would be moved
    below the filter, and all rows would be shuffled after all.
    """
    ids = ids.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(id_cols))).distinct()
    keys = [f"k{i}" for i in range(len(id_cols))]
    words = ids.select(F.shiftright(_slot(keys), 6).alias("word"), F.expr("1L").alias("one"), F.pmod(_slot(keys), F.lit(64)).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("bits"))
    full = [0] * (FILTER_BITS // 64)
    for r in words.toLocalIterator():  # FILTER_BITS / 64 rows at most
        full[r["word"]] = r["bits"]
    name = free_name(rows.columns, "bitmap")
    bitmap = rows.sparkSession.createDataFrame([(full,)], f"{name} array<long>")
    slot = _slot(id_cols)
    word = F.element_at(F.col(name), (F.shiftright(slot, 6) + 1).cast("int"))
    near = rows.crossJoin(F.broadcast(bitmap)).filter(F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1).select(*rows.columns).alias("rows")
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"ids.{k}")) for c, k in zip(id_cols, keys)]
    return near.join(ids.alias("ids"), same).select("rows.*")


def crowded(digests: DataFrame) -> DataFrame:
    """Digests of several rows."""
    return digests.groupBy("digest").count().filter("count > 1").select("digest")


def clashing(canon: DataFrame) -> DataFrame:
    """Digests whose buckets hold different ``canon`` bytes.

    Of each bucket the least and greatest are kept, combined before the shuffle, so a crowd
    of copies costs one row a task.
    """
    spread = canon.groupBy(digest(F.col("canon")).alias("digest")).agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    return spread.filter("lo <> hi").select("digest")


def extended(rows: DataFrame, clashes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with the digest of each (digest, canon) pair lengthened by the bytes' SHA-256 where it clashes; canon columns go."""
    for d, c in pairs:
        marked = clashes.select(F.col("digest").alias("clash"))
        longer = F.when(F.col("clash").isNull(), F.col(d)).otherwise(F.concat_ws("-", d, F.sha2(c, 256)))
        rows = rows.join(marked, F.col(d) == F.col("clash"), "left").withColumn(d, longer).drop("clash", c)
    return rows


def fingerprints(texts: DataFrame, space: Workspace, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols and ``fingerprint`` for every row.

    Null texts count as empty. Repeated ids and null ids are kept, one row for each row of
    ``texts``. No rows give no rows. Columns may have any names; an id column called
    ``fingerprint`` makes two columns of that name.
    """
    keys = [f"i{k}" for k in range(len(id_cols))]
    rows = texts.select(*(F.col(c).alias(k) for c, k in zip(id_cols, keys)), F.col(text_col).alias("text"))
    made = rows.select(*keys, canonical(F.col("text")).alias("canon")).withColumn("digest", digest(F.col("canon")))
    digests = space.write(made.select(*keys, "digest"), "digests")
    ids = space.write(digests.join(crowded(digests), "digest", "left_semi").select(*keys).distinct(), "crowded")
    clashes = space.write(clashing(only(rows, ids, keys).select(canonical(F.col("text")).alias("canon"))), "clashes")
    out = digests if clashes.isEmpty() else extended(made, clashes, [("digest", "canon")])
    return out.select(*(F.col(k).alias(c) for c, k in zip(id_cols, keys)), F.col("digest").alias("fingerprint"))


def successors(rows: DataFrame, space: Workspace, order: list[Column], key: list[str]) -> DataFrame:
    """All columns, and ``next_<c>`` for each c of ``key``: the key of the row that follows in ``order``, after the last the first.

    ``order`` must be total (``key`` its last part), so ties and a hot value are dealt like
    any rows: by range, with a window inside each range only. What crosses a range's edge is
    looked up in a table of one row a range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = space.write(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("range").orderBy(*order)
    led = dealt.select("*", F.row_number().over(inner).alias("place"), F.lead(F.struct(*key)).over(inner).alias("lead"))
    # one row for each range: as many as there are shuffle partitions
    heads = [(r["range"], tuple(r[c] for c in key)) for r in led.filter("place = 1").select("range", *key).orderBy("range").collect()]
    following = [(a[0], *heads[(i + 1) % len(heads)][1]) for i, a in enumerate(heads)]
    after = spark.createDataFrame(following, f"range int, {', '.join(f'edge_{c} {rows.schema[c].dataType.simpleString()}' for c in key)}")
    whole = led.join(F.broadcast(after), "range")
    return whole.select(*rows.columns, *(F.when(F.col("lead").isNull(), F.col(f"edge_{c}")).otherwise(F.col(f"lead.{c}")).alias(f"next_{c}") for c in key))


def edited_likeness(docs: DataFrame, space: Workspace, key: list[str], id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / ``share``) code points replaced by the first
    as many (or all) of the next row's text, in descending order of ``id_col``: equal ids are
    in the order of ``key``, null ids come last, and after the last row comes the first. ``key``
    names columns that tell rows apart and are never null. One row for each row of ``docs``:
    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1.0
    for equal fingerprints, else 0.0). Null texts count as empty; no rows give no rows; other
    columns are not read.
    """
    keys = [f"k{i}" for i in range(len(key))]
    nexts = [f"next_{k}" for k in keys]
    texts = docs.select(*(F.col(c).alias(k) for c, k in zip(key, keys)), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = successors(texts.select(*keys, "id", F.length("text").cast("long").alias("n_chars")), space, [F.desc_nulls_last("id"), *keys], keys)
    order = space.write(order.withColumn("cut", F.floor(F.col("n_chars") / share).cast("int")), "order")
    body = texts.select(*keys, "text")

    def with_edited(own: DataFrame, following: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` with text and edited; ``following`` holds the next rows' texts."""
        owners = wanted.select(*(F.col(k).alias(f"own_{k}") for k in keys), *(F.col(n).alias(k) for n, k in zip(nexts, keys)), "id", "n_chars", "cut")
        heads = following.join(owners, keys).select(*(F.col(f"own_{k}").alias(k) for k in keys), *(F.col(k).alias(n) for n, k in zip(nexts, keys)), "id", "n_chars", "cut", F.expr("substring(text, 1, cut)").alias("head"))
        return own.join(heads, keys).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - cut as int)), head)"))

    def printed(rows: DataFrame) -> DataFrame:
        canon = rows.withColumn("own_canon", canonical(F.col("text"))).withColumn("other_canon", canonical(F.col("edited")))
        return canon.withColumn("own", digest(F.col("own_canon"))).withColumn("other", digest(F.col("other_canon")))

    shown = [*keys, *nexts, "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other"]
    main = space.write(printed(with_edited(body, body, order)).select(*shown), "main")
    both = main.select(*keys, F.expr("stack(2, 0, own, 1, other) as (side, digest)"))
    many = space.write(both.join(crowded(both), "digest", "left_semi").select(*keys, "side"), "crowded")
    own, other = many.filter("side = 0"), order.join(many.filter("side = 1").select(*keys), keys, "left_semi")
    following = only(body, other.select(*(F.col(n).alias(k) for n, k in zip(nexts, keys))), keys)
    again = only(body, own, keys).select(F.col("text").alias("t")).unionByName(with_edited(only(body, other, keys), following, other).select(F.col("edited").alias("t")))
    clashes = space.write(clashing(again.select(canonical(F.col("t")).alias("canon"))), "clashes")
    if not clashes.isEmpty():
        whole = printed(with_edited(body, body, order)).select(*shown, "own_canon", "other_canon")
        main = space.write(extended(whole, clashes, [("own", "own_canon"), ("other", "other_canon")]), "extended")
    near = main.select(*(F.col(k).alias(n) for k, n in zip(keys, nexts)), F.col("own").alias("next_own"))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    out = main.join(near, nexts)
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"), same("own", "other").alias("near_edited"), same("own", "next_own").alias("near_next"))
