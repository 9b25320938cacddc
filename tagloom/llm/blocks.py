"""Blocks of texts, and an exchange of keys between blocks and hash ranges.

Operators that ask of every n-gram of every text "where else does this occur?"
would shuffle a row for each n-gram. Here the texts are first written as blocks
of about BLOCK_BYTES. A block sends each of its distinct keys once, as gap-coded
byte planes, to the task that holds that range of keys; that task answers each
block with a value for each key it sent. A key that a third of all texts share
therefore costs one entry for each block, not one for each text, and no task
ever holds the texts or the occurrences of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, pack_ints, pack_keys, unpack_ints, unpack_keys, unzip_bytes, zip_bytes
from .workspace import Workspace, quoted

#: Bytes of a block at least and at most; between, they grow with the ranges, so that a block has many keys for each.
BLOCK_BYTES = (2 << 20, 16 << 20)
RANGE_BYTES = 640
BLOCK_ROWS = 4_096
#: A range answers about so many blocks' worth of keys at least, so it is bounded however much comes in.
RANGE_BLOCKS = 16
BLOCK_SCHEMA = "block long, ids binary, known binary, sizes binary, body binary, rest binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "sizes", "body", "rest"))])


class Block:
    """rid: row numbers unique over all blocks; doc_id None where it was null; texts as bytes, b'' for null.

    ``rest`` is an Arrow table of other columns, if any were asked for.
    """

    def __init__(self, block, ids, known, sizes, body, rest):
        self.block = block
        self.ids = unpack_ints(ids)
        self.known = unpack_ints(known).astype(bool)
        sizes = unpack_ints(sizes)
        data, ends = unzip_bytes(body), np.cumsum(np.abs(sizes))
        self.null = sizes < 0
        self.texts = [data[e - abs(s) : e] for s, e in zip(np.where(self.null, 0, sizes).tolist(), np.cumsum(np.where(self.null, 0, sizes)).tolist())]
        self.rest = None if rest is None else pa.ipc.open_stream(unzip_bytes(rest)).read_all()
        self.rid = (np.int64(block) << 12) + np.arange(len(self.ids), dtype=np.int64)

    def doc_ids(self) -> list:
        return [i if k else None for i, k in zip(self.ids.tolist(), self.known.tolist())]


def blocks_of(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for row in batch.to_pylist():
        yield Block(*(row[c] for c in BLOCK_ARROW.names))


def _block(number: int, ids: list, texts: list, rest: list[pa.RecordBatch]) -> dict:
    packed = None
    if rest and rest[0].num_columns:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest[0].schema) as stream:
            for part in rest:
                stream.write_batch(part)
        packed = zip_bytes(sink.getvalue().to_pybytes())
    return {
        "rest": packed,
        "block": number,
        "ids": pack_ints(np.array([i or 0 for i in ids], np.int64)),
        "known": pack_ints(np.array([i is not None for i in ids], np.int64)),
        "sizes": pack_ints(np.array([-1 if t is None else len(t) for t in texts], np.int64)),
        "body": zip_bytes(b"".join(t for t in texts if t is not None)),
    }


def write_blocks(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", name: str = "blocks", keep: Sequence[str] = ()) -> DataFrame:
    """Write the id, text and ``keep`` columns of every row as blocks; no shuffle. Block numbers are fixed once written."""
    room = min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], RANGE_BYTES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def cut(batches):
        number, ids, texts, size, rest = TaskContext.get().partitionId() << 24, [], [], 0, []
        for batch in batches:
            others, begun = batch.select(batch.schema.names[2:]), 0
            for at, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= room or len(ids) >= BLOCK_ROWS:
                    rest.append(others.slice(begun, at + 1 - begun))
                    yield pa.RecordBatch.from_pylist([_block(number, ids, texts, rest)], BLOCK_ARROW)
                    number, ids, texts, size, rest, begun = number + 1, [], [], 0, [], at + 1
            rest.append(others.slice(begun))
        if ids:
            yield pa.RecordBatch.from_pylist([_block(number, ids, texts, rest)], BLOCK_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *(F.col(quoted(c)).alias(f"keep_{i}") for i, c in enumerate(keep)))
    return space.write(rows.mapInArrow(cut, BLOCK_SCHEMA), name, "uncompressed")


KEYS_SCHEMA = "bucket int, block long, keys binary, more binary, vals binary"
KEYS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("vals", pa.binary())])


def buckets(blocks: DataFrame) -> int:
    """Hash ranges: the session's shuffle partitions, which follow the input on a cluster, or more where the written blocks need them."""
    return max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // RANGE_BLOCKS))


def deal(block: int, keys: np.ndarray, n: int, vals: np.ndarray | None = None, more: np.ndarray | None = None) -> list[dict]:
    """A row for each hash range of a block's sorted keys; ``more`` are further 64 bits of each key, if keys are that wide."""
    if not len(keys):
        return []
    cuts = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(U64)
    at = np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)])).tolist()
    return [
        {
            "bucket": b,
            "block": block,
            "keys": pack_keys(keys[i:j]),
            "more": None if more is None else pack_ints(more[i:j].view(np.int64)),
            "vals": None if vals is None else pack_ints(vals[i:j]),
        }
        for b, (i, j) in enumerate(zip(at, at[1:]))
        if j > i
    ]


def send_keys(blocks: DataFrame, n: int, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """keys_of(block) gives its sorted distinct keys and an integer for each (or None), for ``n`` ranges."""

    def send(batches):
        for batch in batches:
            for block in blocks_of(batch):
                keys, vals = keys_of(block)
                if rows := deal(block.block, keys, n, vals):
                    yield pa.RecordBatch.from_pylist(rows, KEYS_ARROW)

    return blocks.mapInArrow(send, KEYS_SCHEMA)


def answer_keys(sent: DataFrame, n: int, combine: Callable[[np.ndarray, np.ndarray, int], np.ndarray], summary: Callable[[np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
    """Answer every block: combine(slot, values, n_slots) gives a value for each of a range's distinct keys.

    ``slot`` numbers the distinct key of each entry received. The answers keep the order in which the
    block sent its keys. ``summary(keys, values)`` may give bytes, put on one row (block -1) a range.
    Each of the ``n`` ranges is a partition of its own.
    """

    def answer(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        parts = [unpack_keys(r["keys"]) for r in rows]
        every = np.concatenate(parts)
        if rows[0]["more"] is not None:
            more = np.concatenate([unpack_ints(r["more"]) for r in rows])
            order = np.lexsort((more, every))
            new = np.concatenate(([True], (every[order][1:] != every[order][:-1]) | (more[order][1:] != more[order][:-1])))
            slot, keys = np.empty(len(every), np.int64), every[order][new]
            slot[order] = np.cumsum(new) - 1
        else:
            ordered = np.sort(every)
            keys = ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
            slot = np.searchsorted(keys, every)
        vals = np.concatenate([np.ones(len(p), np.int64) if r["vals"] is None else unpack_ints(r["vals"]) for p, r in zip(parts, rows)])
        found = combine(slot, vals, len(keys))
        ends = np.cumsum(list(map(len, parts))).tolist()
        for i in range(0, len(rows), 256):
            some = [{"bucket": r["bucket"], "block": r["block"], "keys": None, "more": None, "vals": pack_ints(found[slot[e - len(p) : e]])} for r, p, e in zip(rows[i : i + 256], parts[i : i + 256], ends[i : i + 256])]
            yield pa.RecordBatch.from_pylist(some, KEYS_ARROW)
        if summary:
            yield pa.RecordBatch.from_pylist([{"bucket": rows[0]["bucket"], "block": -1, "keys": summary(keys, found), "more": None, "vals": None}], KEYS_ARROW)

    return sent.repartitionById(n, F.col("bucket")).mapInArrow(answer, KEYS_SCHEMA)


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable[[Block, np.ndarray], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """use(block, answers in the order of its keys) gives rows for each block."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in blocks_of(left):
            got = [unpack_ints(r["vals"]) for r in sorted(right.select(["bucket", "vals"]).to_pylist(), key=lambda r: r["bucket"])]
            out += use(block, np.concatenate(got) if got else np.empty(0, np.int64))
        return pa.Table.from_pylist(out, arrow)

    return blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(apply, schema)


def total(slot: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(slot, vals, n).astype(np.int64)


def least(slot: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, slot, vals)
    return out
