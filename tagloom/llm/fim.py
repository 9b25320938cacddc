"""Fill-in-middle: texts cut at unit ends and put together in another order.

Cuts are found by the parallel scan of ``automaton``. A text of up to PIECE bytes is scanned
where it lies. A longer one is dealt as pieces: each task sums its pieces up as functions of
the state they are entered in, the functions are composed group by group, the cuts are
looked for from the top (group, then piece), and only the pieces with a cut are walked once
more. A text in a cell has at most 2**31 bytes, so 2**15 pieces in 2**7 groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import UNITS, Automaton, Scan, runs
from .workspace import Workspace, free_name, quoted

PIECE = 1 << 16
GROUP = 1 << 8
MARKS = ("<P>", "<S>", "<M>")


def hashed(id_col: Column, seed: int, group: int) -> Column:
    """The ``group``-th eight hex digits of the SHA-256 of "<seed>:<id>" as a number; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and bounds of a binary array without nulls."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    wide = pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def _cuts(auto: Automaton):
    @F.arrow_udf("n long, first long, second long")
    def cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        data, offsets = _bytes(text)
        draws, out = np.stack([np.asarray(a), np.asarray(b)]), np.zeros((3, len(text)), np.int64)
        for i, j in runs(offsets):
            scan = Scan(auto, data, offsets[i : j + 1])
            out[0, i:j] = n = scan.units()
            wanted = draws[:, i:j] % (n + 1)
            out[1, i:j], out[2, i:j] = scan.ends_of(wanted.min(0)), scan.ends_of(wanted.max(0))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], fields=list(CUTS))

    return cuts


def _giant_cuts(giants: DataFrame, auto: Automaton, space: Workspace, piece: int) -> DataFrame:
    """rid, n, first, second of texts (rid, text, a, b) that are dealt as pieces."""
    states = auto.states

    def summed(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column("part"))
            for i, j in runs(offsets):
                to, counts, chars = Scan(auto, data, offsets[i : j + 1]).functions()
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([some.column("rid"), some.column("piece"), some.column("part"), pa.array(to.tolist(), pa.list_(pa.int64())), pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array(chars)], ["rid", "piece", "part", "to", "counts", "chars"])

    whole = F.col("text").cast("binary")
    at = F.sequence(F.lit(0), ((F.octet_length("text") - 1) / piece).cast("int"))
    parts = giants.select("rid", F.posexplode(F.transform(at, lambda i: F.substring(whole, i * piece + 1, F.lit(piece)))).alias("piece", "part"))
    pieces = space.write(parts.repartition("rid", "piece").mapInArrow(summed, "rid long, piece int, part binary, to array<long>, counts array<long>, chars long"), "pieces")
    functions = pieces.select("rid", F.col("piece").alias("at"), "to", "counts", "chars")

    def fold(rows: list[dict], state: int, key: str = "at"):
        """Each function in order with the state it is entered in, and units and code points before it."""
        units = chars = 0
        for r in sorted(rows, key=lambda r: r[key]):
            yield r, state, units, chars
            units, chars, state = units + r["counts"][state], chars + r["chars"], r["to"][state]

    def compose(group: pa.Table) -> pa.Table:
        rows, to, counts = group.to_pylist(), [], []
        for s in range(states):
            last, state, units, chars = list(fold(rows, s))[-1]
            to.append(last["to"][state])
            counts.append(units + last["counts"][state])
        return pa.Table.from_pylist([{"rid": rows[0]["rid"], "at": rows[0]["at"] // GROUP, "to": to, "counts": counts, "chars": chars + last["chars"]}])

    groups = functions.groupBy("rid", F.expr(f"at div {GROUP}")).applyInArrow(compose, "rid long, at long, to array<long>, counts array<long>, chars long")

    found = "rid long, which int, n long, at long, entered long, wanted long, before long"
    schema = pa.schema([(c, pa.int32() if c == "which" else pa.int64()) for c in ("rid", "which", "n", "at", "entered", "wanted", "before")])

    def locate(rows: list[dict], entered: int, wanted: int, chars: int, more: dict) -> dict:
        """Where unit ``wanted`` ends: in which of the rows (``at`` null: nowhere inside, ``before`` says it)."""
        if wanted:
            for r, state, units, before in fold(rows, entered):
                if units < wanted <= units + r["counts"][state]:
                    return more | {"at": r["at"], "entered": state, "wanted": wanted - units, "before": chars + before}
            chars += sum(r["chars"] for r in rows)  # closed by the text's end
        return more | {"at": None, "entered": None, "wanted": None, "before": chars}

    def top(texts: pa.Table, group: pa.Table) -> pa.Table:
        text, rows = texts.to_pylist()[0], group.to_pylist()
        last, state, units, _ = list(fold(rows, 0))[-1]
        n = units + last["counts"][state] + int(auto.pending[last["to"][state]])
        low, high = sorted((text["a"] % (n + 1), text["b"] % (n + 1)))
        return pa.Table.from_pylist([locate(rows, 0, w, 0, {"rid": text["rid"], "which": k, "n": n}) for k, w in ((1, low), (2, high))], schema)

    tops = space.write(giants.select("rid", "a", "b").groupBy("rid").cogroup(groups.groupBy("rid")).applyInArrow(top, found), "tops")

    def inner(wants: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        return pa.Table.from_pylist([locate(rows, w["entered"], w["wanted"], w["before"], {c: w[c] for c in ("rid", "which", "n")}) for w in wants.to_pylist()], schema)

    opened = functions.withColumn("group", F.expr(f"at div {GROUP}")).join(tops.filter("at is not null").select("rid", F.col("at").alias("group")).distinct(), ["rid", "group"], "left_semi")
    inners = space.write(tops.filter("at is not null").groupBy("rid", "at").cogroup(opened.groupBy("rid", "group")).applyInArrow(inner, found), "inners")

    def walk(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column("part"))
            wanted, entered = np.asarray(batch.column("wanted")), np.asarray(batch.column("entered"))
            chars = np.empty(len(wanted), np.int64)
            for i, j in runs(offsets):
                chars[i:j] = Scan(auto, data, offsets[i : j + 1]).ends_of(wanted[i:j], entered[i:j])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "which", "n")), pa.array(chars + np.asarray(batch.column("before")))], ["rid", "which", "n", "chars"])

    cut = pieces.select("rid", F.col("piece").cast("long").alias("at"), "part").join(inners, ["rid", "at"])
    ends = cut.mapInArrow(walk, "rid long, which int, n long, chars long").unionByName(tops.filter("at is null").select("rid", "which", "n", F.col("before").alias("chars")))
    return ends.groupBy("rid").agg(F.max("n").alias("n"), F.max(F.when(F.col("which") == 1, F.col("chars"))).alias("first"), F.max(F.when(F.col("which") == 2, F.col("chars"))).alias("second"))


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of. A mark cannot arise across a seam, as no mark's head is its tail."""
    body, spm = F.substr(output, F.lit(4)), form == "spm"
    # one mark in the middle, <P> or <S>, then <M>
    one = F.when(spm, F.locate("<P>", body)).otherwise(F.locate("<S>", body))
    two = F.locate("<M>", body)
    left, right, middle = F.substr(body, F.lit(1), one - 1), F.substr(body, one + 3, two - one - 3), F.substr(body, two + 3)
    return F.when(form == "plain", output).when(spm, F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))


def fill_in_middle(docs: DataFrame, units: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, space: Workspace | None = None) -> DataFrame:
    """id_col, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and the ``keep`` columns, a row for each row of ``docs``.

    Prefix and middle end after the smaller and the larger of two numbers of units that are
    drawn by a hash of the id. ``rate`` of 100 texts are changed, ``spm`` of 100 of these to
    suffix, prefix, middle; the rest to prefix, suffix, middle. A text that is empty or holds
    a mark stays plain (lengths null). Null texts count as empty, a null id as an empty one;
    repeated rows are changed alike, each for itself. No rows give no rows. Columns that are not kept are not
    read; columns of any names may be kept besides the six.
    """
    auto, space = UNITS[units], space or Workspace(docs.sparkSession, "fim")
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"), *(F.col(quoted(c)).alias(k) for c, k in zip(keep, kept)))
    drawn = rows.withColumns({"a": hashed(F.col("id"), seed, 0), "b": hashed(F.col("id"), seed, 1)})
    near = drawn.filter(F.octet_length("text") <= piece).withColumn("c", _cuts(auto)(F.col("text").cast("binary"), "a", "b"))
    near = near.select("id", "text", *kept, "c.n", "c.first", "c.second")
    # rows are told apart by a number that is fixed by writing them
    giants = space.write(drawn.filter(F.octet_length("text") > piece).withColumn("rid", F.monotonically_increasing_id()), "giants")
    if not giants.isEmpty():
        near = near.unionByName(giants.join(_giant_cuts(giants, auto, space, piece), "rid").select("id", "text", *kept, "n", "first", "second"))
    text, marked = F.col("text"), F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (hashed(F.col("id"), seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(hashed(F.col("id"), seed, 3) % 100 < spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.substr(text, F.lit(1), F.col("first").cast("int")), F.substr(text, (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int")), F.substr(text, (F.col("second") + 1).cast("int"))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    changed = F.col("form") != "plain"
    return near.withColumn("form", form).select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.when(changed, F.col("first")).alias("prefix_chars"),
        F.when(changed, F.col("second") - F.col("first")).alias("middle_chars"),
        output.alias("output"),
        *(F.col(k).alias(c) for c, k in zip(keep, kept)),
    )
