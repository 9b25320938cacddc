"""Substring dedup: winnowed anchors say which windows to look up, and each of those is looked up exactly.

1. In every run of ``window`` words the least ``anchor``-word shingle is an anchor, so two
   documents that share a window share its anchor. Blocks of texts send their distinct
   anchors once; an anchor held by two documents or more is a seed (``blocks.py``).
2. Seeds are not extended and no pairs of documents are formed, as a passage that n documents
   hold has n * (n - 1) / 2 of them. The candidate windows are those whose own anchor is a
   seed; each is looked up whole, by its key, with the least doc_id it starts in.
3. A window that also starts in a smaller document is a repeat; neighbouring repeats are
   one maximal repeat, of ``window`` words at least, and its words are removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import KEYS_ARROW, KEYS_SCHEMA, Block, answer_keys, blocks_of, buckets, deal, least, send_keys, total, with_answers, write_blocks
from .textkit import EXACT, GRAM, GRAM_WIDE, U64, Texts, unpack_ints
from .workspace import Workspace, quoted

ANCHOR = 5
LARGE = np.iinfo(np.int64).max
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.int64())), ("text_crc32", pa.int64())])


def _least_of(keys: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` consecutive keys."""
    out = keys[: len(keys) - span + 1].copy()
    for k in range(1, span):
        np.minimum(out, keys[k : k + len(out)], out=out)
    return out


class Windows:
    """A block's windows: ``start`` (word index), ``anchor`` (its least shingle) and text ``doc`` of each."""

    def __init__(self, block: Block, window: int, anchor: int = ANCHOR):
        self.texts = Texts(block.texts, EXACT)
        keys, _ = self.texts.grams(anchor)
        span = window - anchor + 1
        if len(keys) < span:
            self.start = np.empty(0, np.int64)
            self.anchor = np.empty(0, U64)
        else:
            low = _least_of(keys, span)
            first, last = self.texts.doc[: len(low)], self.texts.doc[window - 1 :]
            self.start = np.flatnonzero(first == last)
            self.anchor = low[self.start]
        self.doc = self.texts.doc[self.start]

    def anchors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and 2 for those in documents of several ids, else 1."""
        if not len(self.anchor):
            return np.empty(0, U64), np.empty(0, np.int64)
        order = np.lexsort((ids[self.doc], self.anchor))
        keys, who = self.anchor[order], ids[self.doc][order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        last = np.append(at[1:], len(keys)) - 1
        return keys[at], 1 + (who[at] != who[last]).astype(np.int64)

    def candidates(self, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which windows have a seed as anchor; ``held`` answers ``keys``."""
        if not len(keys):
            return np.empty(0, np.int64)
        return np.flatnonzero(held[np.searchsorted(keys, self.anchor)] > 1)

    def window_keys(self, window: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of 128-bit keys."""
        return tuple(self.texts.grams(window, factors)[0][self.start[which]] if len(which) else np.empty(0, U64) for factors in (GRAM, GRAM_WIDE))


def _order_ids(block: Block) -> np.ndarray:
    """doc_ids for comparison; a null id counts as greater than any."""
    return np.where(block.known, block.ids, LARGE)


class Candidates:
    """The windows of a block whose anchor is a seed, and their distinct keys in order, with the least doc_id of each."""

    def __init__(self, block: Block, w: Windows, window: int, held: np.ndarray):
        ids = _order_ids(block)
        self.which = w.candidates(w.anchors(ids)[0], held)
        one, two = w.window_keys(window, self.which)
        order = np.lexsort((two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(order)]
        at = np.flatnonzero(new)
        self.keys, self.more = one[order][at], two[order][at]
        #: which of the distinct keys each window has
        self.slot = np.empty(len(order), np.int64)
        self.slot[order] = np.cumsum(new) - 1
        self.lowest = np.minimum.reduceat(ids[w.doc[self.which]][order], at) if len(at) else np.empty(0, np.int64)


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None, layout: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed, text_crc32 (of the input text).

    kept_text is the kept words joined by one space or, with ``layout``, the text with the removed
    words and the white space after each run of them cut out; ``removed`` lists the maximal removed
    runs as start, length, start, length... in words. Windows are judged on the input. Null,
    empty and short texts lose nothing. Columns named in ``keep`` follow as keep_0, keep_1... Repeats inside one document, or between rows of the
    same doc_id, are kept; a null doc_id counts as the greatest. No rows give no rows. Other
    columns are not read. Window keys have 128 bits: n distinct windows have n * n / 2**129 pairs
    that are taken for equal, 3e-13 of one for the 1e13 windows of 100 TB.
    """
    space = space or Workspace(docs.sparkSession, "substr")
    blocks = write_blocks(docs, space, id_col, text_col, keep=keep)
    n = buckets(blocks)
    held = space.write(answer_keys(send_keys(blocks, n, lambda b: Windows(b, window).anchors(_order_ids(b))), n, total), "seeds", "uncompressed")

    def extend(block: Block, got: np.ndarray) -> list[dict]:
        found = Candidates(block, Windows(block, window), window, got)
        return deal(block.block, found.keys, n, found.lowest, found.more)

    sent = with_answers(blocks, held, extend, KEYS_SCHEMA, KEYS_ARROW)
    firsts = answer_keys(sent, n, least)

    def strip(block: Block, seeds: np.ndarray, first: np.ndarray) -> list[dict]:
        w = Windows(block, window)
        found = Candidates(block, w, window, seeds)
        t = w.texts
        covered = np.zeros(len(t.key) + 1, np.int64)
        if len(found.keys):
            ids = _order_ids(block)
            hit = found.which[first[found.slot] < ids[w.doc[found.which]]]
            begins = w.start[hit]
            np.add.at(covered, begins, 1)
            np.add.at(covered, begins + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        out = []
        for d, doc_id in enumerate(block.doc_ids()):
            a, b = int(t.first[d]), int(t.first[d] + t.n_words[d])
            body, mask, runs = block.texts[d], gone[a:b], []
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                runs = np.stack([edges[0::2], edges[1::2] - edges[0::2]], 1).ravel().tolist()
            if layout:
                starts = np.append(t.starts[a:b], t.ends[b - 1] if b > a else 0) - t.begins[d]
                cuts = [0, *(int(starts[x]) for i in range(0, len(runs), 2) for x in (runs[i], runs[i] + runs[i + 1])), len(body)]
                kept = b"".join(body[x:y] for x, y in zip(cuts[0::2], cuts[1::2]))
            else:
                words = body.split()
                kept = b" ".join([x for x, g in zip(words, mask.tolist()) if not g] if runs else words)
            out.append({"doc_id": doc_id, "n_words": b - a, "n_removed": int(mask.sum()), "kept_text": kept.decode("utf-8", "replace"), "removed": runs, "text_crc32": None if block.null[d] else zlib.crc32(block.texts[d])})
        return out

    kinds = docs.select(*map(quoted, keep)).schema.fields
    return _with_two(blocks, held, firsts, strip, [T.StructField(f"keep_{i}", k.dataType) for i, k in enumerate(kinds)])


def _with_two(blocks: DataFrame, first: DataFrame, second: DataFrame, use, kept: list[T.StructField]) -> DataFrame:
    """Each block with the answers of two exchanges, told apart by an offset of the bucket number."""
    shift = 1 << 30
    both = first.unionByName(second.withColumn("bucket", (F.col("bucket") + shift).cast("int")))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.select(["bucket", "vals"]).to_pylist(), key=lambda r: r["bucket"])
        one = [unpack_ints(r["vals"]) for r in rows if r["bucket"] < shift]
        two = [unpack_ints(r["vals"]) for r in rows if r["bucket"] >= shift]
        none = np.empty(0, np.int64)
        out = []
        for block in blocks_of(left):
            made = pa.Table.from_pylist(use(block, np.concatenate(one) if one else none, np.concatenate(two) if two else none), OUT)
            for i, field in enumerate(kept):
                made = made.append_column(field.name, block.rest.column(i))
            out.append(made)
        return pa.concat_tables(out)

    schema = T.StructType([*T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string, removed array<long>, text_crc32 long").fields, *kept])
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(apply, schema)
