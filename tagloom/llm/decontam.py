"""Benchmark decontamination: seeds that no alignment can do without, then Smith-Waterman alignment.

1. An alignment of score S has, between matched words that follow each other, c0 gaps without
   an edit and c1 gaps of one edit, and S <= MATCH + 2 c0 + c1, as any other gap costs what a
   match gives. A gap of at most one edit is a pair of words no more than two apart both in
   the item and in the text. The seeds of an item are its pairs: a pair of neighbours in both
   weighs 2, any other 1, and a document can only reach ``threshold`` where the seeds of a
   stretch as long as an alignment can be weigh MATCH (threshold * words - 1) or more. An item
   of fewer than LEAST_WORDS words, of which any one would do, is looked for whole: its seed
   is its only pair or word.
2. How often each pair occurs in the corpus is counted. The commonest pairs of an item are not
   looked up, up to half of the weight needed, which is then taken off what the others must
   weigh. So the counts settle the cost and never what is found.
3. Where the seeds weigh enough, document and item are aligned, word by word, case and
   punctuation aside. The score is the best local alignment's share of a perfect one, so
   copies with words changed, dropped or put in are found, all that reach the threshold.

Items are taken in blocks of bounded size, each broadcast and held against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import EXACT, GRAM, U64, Texts, mix
from .workspace import Workspace

LEAST_WORDS = 3
APART = (1, 2)
PREFIX_BITS = 20
THRESHOLD = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
ITEM_BLOCK_BYTES = 16 << 20
#: ASCII punctuation parts words, so that marks put to a word do not hide it.
PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(PLAIN)


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word-key arrays and the word of ``text`` after its end, the first if there are several."""
    width = len(text)
    if not width or not len(item):
        return 0, 0
    ramp = -GAP * np.arange(1, width + 1)
    row, best, end = np.zeros(width + 1, np.int64), 0, 0
    for word in item:
        hit = np.where(text == word, MATCH, MISMATCH)
        open_ = np.maximum(np.maximum(row[:-1] + hit, row[1:] + GAP), 0)
        # gaps along the text: the best earlier cell less the distance
        row[1:] = np.maximum.accumulate(open_ + ramp) - ramp
        top = int(row.max())
        if top > best or top == best > 0:
            at = int(row.argmax())
            end = at if top > best else min(end, at)
            best = top
    return best, end


def passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score, its first word of ``text`` and the word after its last; of several, one that ends first."""
    score, end = smith_waterman(item, text)
    # all that score as much in the words up to there end there
    return score, end - smith_waterman(item[::-1], text[:end][::-1])[1], end


def pairs(key: np.ndarray, apart: int) -> np.ndarray:
    """Keys of each word with the word ``apart`` after it (0: of the word itself)."""
    return mix(key[: len(key) - apart] * GRAM[0] + key[apart:] * GRAM[1]) if len(key) > apart else np.empty(0, U64)


class Lookup:
    """A sorted table of distinct keys, with a bit table that spares most searches."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.some = np.zeros(1 << PREFIX_BITS, bool)
        self.some[table >> U64(64 - PREFIX_BITS)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` of those in the table, and where in the table they are."""
        maybe = np.flatnonzero(self.some[keys >> U64(64 - PREFIX_BITS)])
        at = np.searchsorted(self.table, keys[maybe])
        at[at == len(self.table)] = 0
        same = self.table[at] == keys[maybe] if len(self.table) else np.zeros(len(maybe), bool)
        return maybe[same], at[same]


class Items:
    """Items' word keys and their pairs; ``apart`` are the distances at which texts are searched."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float = THRESHOLD):
        self.ids = [i for i, _ in rows]
        t = Texts([b for _, b in rows], EXACT)
        self.words = [t.key[t.first[d] : t.first[d] + t.n_words[d]] for d in range(len(rows))]
        sizes = np.array([len(w) for w in self.words], np.int64)
        short = sizes < LEAST_WORDS
        self.need = np.where(short, sizes, MATCH * (threshold * sizes - 1)) - 1e-9
        self.apart = (0, *APART) if (sizes == 1).any() else APART
        #: the most words of a text an alignment that reaches the threshold can take
        self.reach = np.maximum(sizes, np.ceil((1 + MATCH * (1 - threshold)) * sizes).astype(np.int64)) + 1
        self.pairs = [[pairs(w, a) if a == (len(w) - 1 if len(w) < LEAST_WORDS else a) and (a or len(w) == 1) else w[:0] for a in self.apart] for w in self.words]
        self.vocabulary = Lookup(np.unique(np.concatenate([*(p for two in self.pairs for p in two), np.empty(0, U64)])))

    def choose(self, freq: np.ndarray) -> None:
        """Leave out each item's commonest pairs; ``freq`` are the counts of ``vocabulary``."""
        seeds, owners, nears = [], [], []
        for n, two in enumerate(self.pairs):
            key = np.concatenate(two)
            if not len(key):
                continue
            place = np.concatenate([np.arange(len(p)) for p in two])
            weight = np.repeat([1 + (a == 1) for a in self.apart], [len(p) for p in two])
            distinct, of = np.unique(key, return_inverse=True)
            order = np.argsort(of, kind="stable")
            spans = np.split(order, np.cumsum(np.bincount(of))[:-1])
            often = freq[np.searchsorted(self.vocabulary.table, distinct)]
            # of what begins at one word of the item an alignment has one pair at most
            lost, room, out = np.zeros(len(self.words[n]), np.int64), self.need[n] / 2 if len(self.words[n]) >= LEAST_WORDS else 0, np.zeros(len(distinct), bool)
            for k in np.argsort(-often, kind="stable").tolist():
                more = lost.copy()
                np.maximum.at(more, place[spans[k]], weight[spans[k]])
                if more.sum() > room:
                    break
                lost, out[k] = more, True
            self.need[n] -= lost.sum()
            near = np.zeros(len(distinct), bool)
            near[of[weight == 2]] = True
            seeds.append(distinct[~out])
            owners.append(np.full(int((~out).sum()), n))
            nears.append(near[~out])
        seed = np.concatenate([*seeds, np.empty(0, U64)])
        order = np.argsort(seed, kind="stable")
        table, self.low = np.unique(seed[order], return_index=True)
        self.low = np.append(self.low, len(seed))
        self.seed = Lookup(table)
        self.owner = np.concatenate([*owners, np.empty(0, np.int64)])[order]
        self.near = np.concatenate([*nears, np.empty(0, bool)])[order]


def _text_blocks(batches) -> Iterator[tuple[list, Texts]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [plain(t) for t in batch.column(1).to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
                size += len(texts[j])
                j += 1
            yield ids[i:j], Texts(texts[i:j], EXACT)
            i = j


def _spots(t: Texts, table: Lookup, apart: tuple[int, ...] = APART) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance: the words whose pair is in ``table``, and where it is there."""
    for a in apart:
        spots, at = table.find(pairs(t.key, a))
        inside = t.doc[spots] == t.doc[spots + a]
        yield a, spots[inside], at[inside]


def _stretches(items: Items, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and last word of the stretches of text whose seeds weigh enough."""
    found = []
    for apart, spots, at in _spots(t, items.seed, items.apart):
        many = items.low[at + 1] - items.low[at]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.low[at], many)
        weight = 1 + (items.near[entry] & (apart == 1))
        found.append(items.owner[entry] << 34 | np.repeat(spots, many) << 2 | weight)
    packed = np.sort(np.concatenate(found))
    where = packed >> 2
    last = np.append(where[1:] != where[:-1], True) if len(where) else np.empty(0, bool)
    where, weight = where[last], packed[last] & 3
    item, spot = where >> 32, where & (1 << 32) - 1
    begin = np.maximum(spot - items.reach[item] + 1, t.first[t.doc[spot]]) if len(spot) else spot
    start = np.searchsorted(where, item << 32 | begin)
    sums = np.concatenate(([0], np.cumsum(weight)))
    enough = np.flatnonzero(sums[1:] - sums[start] >= items.need[item])
    return item[enough], spot[start[enough]], spot[enough]


def _align(items: Items, ids: list, t: Texts, threshold: float) -> Iterator[dict]:
    item, begin, end = _stretches(items, t)
    if not len(item):
        return
    doc = t.doc[begin]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    for a, b in zip(new, np.append(new[1:], len(doc))):
        d, n = int(doc[a]), int(item[a])
        words, first, reach = items.words[n], int(t.first[d]), int(items.reach[n])
        stop = first + int(t.n_words[d])
        best = (0, 0, 0)
        # stretches whose surroundings meet are one passage
        low, high = begin[a:b], end[a:b]
        cut = np.flatnonzero(low[1:] - high[:-1] > 2 * reach) + 1
        for x, y in zip(np.split(low, cut), np.split(high, cut)):
            lo, hi = max(first, int(x[0]) - reach), min(stop, int(y[-1]) + reach + 1)
            score, start, after = passage(words, t.key[lo:hi])
            if score > best[0]:
                best = (score, lo + start - first, lo + after - first)
        share = best[0] / (MATCH * len(words))
        if share >= threshold:
            yield {"doc_id": ids[d], "item_id": items.ids[n], "score": share, "start_word": best[1], "end_word": best[2]}


def _item_blocks(items: DataFrame, id_col: str, text_col: str, threshold: float) -> Iterator[Items]:
    rows, size = [], 0
    for r in items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).orderBy(id_col).toLocalIterator():
        rows.append((r[0], plain(r[1])))
        size += len(r[1])
        if size >= ITEM_BLOCK_BYTES:
            yield Items(rows, threshold)
            rows, size = [], 0
    if rows:
        yield Items(rows, threshold)


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", space: Workspace | None = None) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of each document and item aligned to ``threshold`` or more.

    Null or empty texts and items match nothing. Items of one or two words match where they stand whole.
    Repeated rows and ids are reported for each row. Empty tables give no rows. Extra columns
    are not read. start_word and end_word bound the best passage (the end not in it), in words parted by space or punctuation.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark, "decontam")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items_now in _item_blocks(items, item_col, text_col, threshold):
        shared = spark.sparkContext.broadcast(items_now)

        def tally(batches, shared=shared):
            table, apart = shared.value.vocabulary, shared.value.apart
            total = np.zeros(len(table.table), np.int64)
            for _, t in _text_blocks(batches):
                for _, _, at in _spots(t, table, apart):
                    total += np.bincount(at, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["slot", "n"])

        freq = np.zeros(len(items_now.vocabulary.table), np.int64)
        # as many rows as the block of items has pairs
        for r in rows.mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
            freq[r["slot"]] = r["n"]
        items_now.choose(freq)
        chosen = spark.sparkContext.broadcast(items_now)

        def align(batches, chosen=chosen):
            for ids, t in _text_blocks(batches):
                if found := list(_align(chosen.value, ids, t, threshold)):
                    yield pa.RecordBatch.from_pylist(found, HIT)

        part = rows.mapInArrow(align, "doc_id long, item_id long, score double, start_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long") if out is None else out
