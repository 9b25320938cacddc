"""Spelling variants: words one edit apart, and the form that each belongs to.

Candidates come from an inverted index of positional q-grams. One edit touches at most Q
grams of a word with padded ends, so of the longer word's grams all but Q recur in the other
at the same place, or one place earlier behind a deletion (count filter). Hence, in one
order of all grams (rare first), two such words share one of their first Q + 1 grams. Words
are therefore dealt by each of those grams and the length, and each such group has its own
index: a word's posting lists, limited to one length and to the places it allows, are merged
by a heap; words that recur often enough are verified. A pair is given by the group of its
first common gram alone. A group of more than LIMIT grams is split: its words are dealt over
slices, each with an index of its own, and every word is held against each slice.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, quoted

Q = 4
#: Grams of a group's index; larger with the table, so that split groups are at most SPLIT_GROUPS and can be broadcast.
LIMIT = 1 << 18
SPLIT_GROUPS = 50_000
#: Slots of the table of gram counts; it settles an order only, so grams may share slots.
GRAM_SLOTS = 1 << 20
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 1 << 18
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def word_counts(docs: DataFrame, drop: int = 0, least_chars: int = 6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: letter runs of whole texts, A-Z lower-cased, of ``least_chars`` code points and ``least`` occurrences.

    With ``drop``, a run whose hash h (crc32 of "<id>:<run>") it divides loses its code point
    h % length first. Null texts have no runs; a null id is hashed as an empty one. No rows
    give no rows; other columns are not read.
    """
    wanted = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def run(batches):
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = (text or b"").lower().decode("utf-8", "replace")
                found = Counter(wanted.findall(low) if len(low) < 1 << 20 else map(itemgetter(0), wanted.finditer(low)))
                if not drop:
                    total.update(found)
                else:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % drop:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_chars:
                                continue
                        total[word] += n
                if len(total) > COUNTED:
                    yield handed()
        yield handed()

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def grams(word: str) -> list[str]:
    """Q-grams by place; both ends are padded with a character that no word has."""
    padded = "\0" * (Q - 1) + word + "\0" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % GRAM_SLOTS


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How often each slot's grams occur in the words: GRAM_SLOTS numbers, whatever the table."""

    def run(batches):
        counts = np.zeros(GRAM_SLOTS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for gram in grams(word):
                    counts[_slot(gram)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])

    out = np.zeros(GRAM_SLOTS, np.int64)
    for r in words.select("word").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


def first_grams(word: str, counts: np.ndarray) -> list[tuple[int, str, int]]:
    """The Q + 1 first grams as (count, gram, place), rare ones first; one edit leaves one of them."""
    return heapq.nsmallest(Q + 1, ((int(counts[_slot(g)]), g, i) for i, g in enumerate(grams(word))))


def one_edit(a: str, b: str) -> bool:
    """Whether one code point inserted into ``a`` or replaced in it makes the other word ``b``, which is no shorter."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and i < n if n == len(b) else a[i:] == b[i + 1 :]


def group_key(gram: str, length: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{length}:{gram}".encode("utf-8", "surrogatepass")) >> 1


class Index:
    """Posting lists of the words of one group, by gram, place and length."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words, self.lists = words, {}
        for k, (word, _) in enumerate(words):
            for i, gram in enumerate(grams(word)):
                self.lists.setdefault((gram, i, len(word)), []).append(k)

    def near(self, word: str, length: int) -> Iterator[tuple[str, int]]:
        """Words of that length (that of ``word`` or one less) that are one edit from it."""
        shorter, lists, missing = length < len(word), [], 0
        for i, gram in enumerate(grams(word)):
            found = self.lists.get((gram, i, length))
            if shorter and i and (moved := self.lists.get((gram, i - 1, length))):
                found = moved if found is None else sorted({*found, *moved})
            if found is not None:
                lists.append(found)
            else:
                missing += 1
                if missing > Q:  # more than one edit can touch
                    return
        lists.sort(key=len)
        # who recurs in all lists but Q (the missing ones among them) is in one of the shortest
        few = Q - missing + 1
        need, long = len(word) - 1, lists[few:]
        for k, same in groupby(heapq.merge(*lists[:few])):
            count, left = sum(1 for _ in same), len(long)
            for postings in long:
                if count + left < need:
                    break
                at = bisect_left(postings, k)
                count += at < len(postings) and postings[at] == k
                left -= 1
            if count >= need and one_edit(self.words[k][0], word):
                yield self.words[k]


PAIRS = pa.schema([("a", pa.string()), ("an", pa.int64()), ("b", pa.string()), ("bn", pa.int64())])


def near_words(words: DataFrame, space: Workspace, limit: int = LIMIT) -> DataFrame:
    """a, an, b, bn: each pair of words (word, n) one edit apart, once; a is the shorter, or the lesser.

    Words are distinct and of two code points at least: those of one are all one edit apart and share no gram.
    """
    counts = _gram_counts(words)

    def deal(batches):
        for batch in batches:
            out = {"key": [], "other": [], "word": [], "n": [], "cost": []}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(word)
                first = {g for _, g, _ in first_grams(word, counts)}
                # a word is in a group once, even if keys of its grams should collide
                for key, length in {group_key(g, length): length for length in (size, size - 1) for g in first}.items():
                    for c, v in zip(out, (key, length < size, word, n, size + Q - 1)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()))], list(out))

    rows = words.select("word", "n").mapInArrow(deal, "key long, other boolean, word string, n long, cost long")
    dealt = space.write(rows, "dealt")
    sizes = dealt.filter("not other").groupBy("key").agg(F.sum("cost").alias("cost"))
    whole = dealt.filter("not other").agg(F.sum("cost")).first()[0] or 0
    room = max(limit, whole // SPLIT_GROUPS)
    split = space.write(sizes.filter(F.col("cost") > room).select("key", F.ceil(F.col("cost") / room).cast("int").alias("slices")), "split")
    # at most SPLIT_GROUPS rows, as the groups' costs sum up to ``whole``
    every = dealt.join(F.broadcast(split), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.when(~F.col("other"), F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    sliced = every.select("key", "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    sent = sliced.select("key", "slice", "word", "n", F.coalesce(F.col("own") == F.col("slice"), F.lit(False)).alias("member"))
    # members first, so that the index is there when the others come
    grouped = sent.repartition(F.col("key"), F.col("slice")).sortWithinPartitions("key", "slice", F.desc("member"))

    def found(index: Index, word: str, n: int, key: int) -> Iterator[tuple[str, int, str, int]]:
        size, own = len(word), None
        for length in (size, size - 1):
            for other, m in index.near(word, length):
                if length == size and other > word:
                    continue  # found from the other side
                own = own or [(c, g) for c, g, _ in first_grams(word, counts)]
                theirs = {(c, g) for c, g, _ in first_grams(other, counts)}
                if group_key(next(g for c, g in own if (c, g) in theirs), length) == key:
                    yield other, m, word, n

    def search(batches):
        at, members, out, index = None, [], [], None
        for batch in batches:
            for key, part, word, n, member in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != at:
                    if members and index is None:
                        index = Index(members)
                    out += [p for w, m in members for p in found(index, w, m, at[0])]
                    at, members, index = (key, part), [], None
                if member:
                    members.append((word, n))
                elif members:
                    index = index or Index(members)
                    out += found(index, word, n, key)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], f.type) for k, f in enumerate(PAIRS)], schema=PAIRS)
            out = []
        if members:
            index = index or Index(members)
            for i in range(0, len(members), 4_096):
                out = [p for w, m in members[i : i + 4_096] for p in found(index, w, m, at[0])]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], f.type) for k, f in enumerate(PAIRS)], schema=PAIRS)

    return grouped.mapInArrow(search, "a string, an long, b string, bn long")


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """word, root for every row of ``forms`` (word, form): the end of the chain, in rounds that double the steps taken."""
    links, turn = space.write(forms.select("word", F.col("form").alias("root")), "roots_0"), 0
    while True:
        nexts = links.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = links.join(nexts, links["root"] == nexts["at"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        turn += 1
        after = space.write(moved, f"roots_{turn}")
        links = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, space: Workspace, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n; distinct words of two code points at least).

    Near words differ by one inserted, deleted or replaced code point. A word's form is its
    near word of largest n (ties: the least by code point) if that is ``ratio`` times its own
    n; its root the end of the chain of forms, or itself. A chain is short, as each step
    multiplies n. No rows give no rows.
    """
    pairs = space.write(near_words(words, space, limit), "pairs")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")))).alias("s")).select("s.*")
    # combined before the shuffle, so a word of many neighbours costs a row a task
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = space.write(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "known")
    ends = roots(known.filter("form is not null"), space)
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
