"""Toxicity scores by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is reduced to its words in lower case, parted by one blank; its features are the
distinct n-grams of code points that do not reach beyond a word and the blanks at its two
ends, at each of LEVELS of how often the text has them. Over labelled texts the smoothed log ratio of a feature's share among toxic and among
other texts scales it. Only features whose counts depart from the labels' shares by more
than chance (a likelihood-ratio test) weigh at all, so what long texts hold by chance adds
nothing and no text is scored by its length. A logistic regression is fitted on the scaled
features, and its scores are made probabilities of the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import U64, mix, unzip_bytes, zip_bytes
from .workspace import importable

SIZES = (3, 4, 5, 6)
LEVELS = (1, 2, 3, 5)
SAMPLE = (4_000, 2_000)  # texts of label 0 and 1 at most
SLOT_BITS = 21
#: Twice the log likelihood ratio that a feature must reach: chance does so about once in five million.
EVIDENCE = 28.0
PIECE = 1 << 19
BLANK = 32
STEP = U64(0x9E3779B97F4A7C15)
_other = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    return " " + _other.sub(" ", text.lower()).strip() + " "


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places and 64-bit keys of the n-grams inside one word and its two blanks, for an array of code points.

    Pieces of bounded size, which overlap by what the longest n-gram needs: every n-gram is given once.
    """
    last = max(SIZES) - 1
    for i in range(0, len(points), PIECE):
        here = points[i : i + PIECE + last].astype(U64)
        blank = here == BLANK
        acc, inner = here + U64(1), np.zeros(len(here), bool)
        for n in range(2, last + 2):
            m = len(here) - n + 1
            if m <= 0:
                break
            if n > 2:
                inner = inner[:m] | blank[n - 2 : n - 2 + m]
            else:
                inner = inner[:m]
            acc = acc[:m] * STEP + here[n - 1 : n - 1 + m]
            if n in SIZES:
                own = np.flatnonzero(~inner[: min(m, PIECE)])
                yield i, own, mix(acc[own] + U64(n))


def keys_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of one whole text, in order, and how often it has each."""
    points = np.frombuffer(letters(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, often = np.empty(0, U64), np.empty(0, np.int64)
    for _, _, keys in grams(points):
        more, times = np.unique(keys, return_counts=True)
        both = np.concatenate((found, more))
        found, at = np.unique(both, return_inverse=True)
        often = np.bincount(at, np.concatenate((often, times)), len(found)).astype(np.int64)
    return found, often


class Chosen:
    """A sorted table of feature keys with a bit table that spares most searches."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.some = np.zeros(1 << SLOT_BITS, bool)
        self.some[table >> U64(64 - SLOT_BITS)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` of those in the table, and where there."""
        maybe = np.flatnonzero(self.some[keys >> U64(64 - SLOT_BITS)])
        if not len(maybe) or not len(self.table):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.table, keys[maybe]), len(self.table) - 1)
        same = self.table[at] == keys[maybe]
        return maybe[same], at[same]

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, place in the table, level reached) of the distinct n-grams of each of some texts, sorted."""
        plain = [letters(t) for t in texts]
        edges = np.cumsum([0, *map(len, plain)])
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = [np.empty(0, np.int64)]
        for first, own, keys in grams(points):
            which, at = self.find(keys)
            # two blanks part the texts, so no n-gram reaches from one into the next
            found.append((np.searchsorted(edges, first + own[which], "right") - 1) * len(self.table) + at)
        every, often = np.unique(np.concatenate(found), return_counts=True)
        size = max(1, len(self.table))
        return every // size, every % size, np.searchsorted(LEVELS, often, "right") - 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: tuple[int, int] = SAMPLE) -> list[tuple[bytes, int]]:
    """(packed text, label) of at most ``size[y]`` different texts of label y, those of least text hash.

    Labels other than 0 and 1 and null ids teach nothing. An id with both labels counts as 1.
    Null texts count as empty. Which texts are taken is settled on (id, text hash, label) rows;
    the texts themselves are fetched once, by a broadcast of the hashes taken.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    bodies = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(5), text).alias("h"))
    hashes = bodies.join(known, "id").groupBy("h").agg(F.max("y").alias("y"))
    taken = [r for y in (0, 1) for r in hashes.filter(F.col("y") == y).orderBy("h").limit(size[y]).collect()]  # bounded by ``size``
    wanted = docs.sparkSession.createDataFrame([(r["h"], r["y"]) for r in taken], "h long, y int")
    rows = docs.select(F.xxhash64(F.lit(5), text).alias("h"), text.alias("body")).join(F.broadcast(wanted), "h")
    once: dict[int, tuple[bytes, int]] = {}
    # copies of a text come once for each task at most
    for r in rows.groupBy("h", "y").agg(F.first("body").alias("body")).toLocalIterator():
        once[r["h"]] = (zip_bytes(r["body"].encode("utf-8", "surrogatepass")), r["y"])
    return [once[h] for h in sorted(once)]


def evidence(up: np.ndarray, down: np.ndarray, ups: float, downs: float) -> np.ndarray:
    """Twice the log likelihood ratio of counts among two groups of texts against one common share."""
    n = ups + downs

    def term(k, of, all_k):
        expected = np.maximum(all_k * of / n, 1e-12)
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / expected), 0.0)

    both = up + down
    return 2 * (term(up, ups, both) + term(ups - up, ups, n - both) + term(down, downs, both) + term(downs - down, downs, n - both))


def choose(examples: list[tuple[bytes, int]], smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram keys, in order, and of each at each level the log-count ratio and whether the feature weighs.

    Texts are counted by hashed slots first, which bounds memory; then the keys in the slots
    that pass are counted each for itself.
    """
    sizes = [float(sum(y == k for _, y in examples)) for k in (0, 1)]
    deep, shift = len(LEVELS), U64(64 - SLOT_BITS)
    lists = lambda: ((*keys_of(unzip_bytes(b).decode("utf-8", "surrogatepass")), y) for b, y in examples)
    counts = np.zeros((2, deep, 1 << SLOT_BITS), np.int32)
    for keys, often, y in lists():
        for level, least in enumerate(LEVELS):
            counts[y, level][np.unique(keys[often >= least] >> shift)] += 1
    passed = np.zeros(1 << SLOT_BITS, bool)
    for level in range(deep):
        for i in range(0, 1 << SLOT_BITS, 1 << 18):
            part = slice(i, i + (1 << 18))
            passed[part] |= evidence(counts[1, level, part], counts[0, level, part], sizes[1], sizes[0]) >= EVIDENCE
    del counts
    kept = []
    for keys, often, y in lists():
        some = passed[keys >> shift]
        kept.append((keys[some], often[some], y))
    table = np.unique(np.concatenate([np.empty(0, U64), *(k for k, _, _ in kept)]))
    tally = np.zeros((2, len(table), deep))
    for keys, often, y in kept:
        tally[y][np.searchsorted(table, keys)] += often[:, None] >= np.array(LEVELS)
    strong = evidence(tally[1], tally[0], sizes[1], sizes[0]) >= EVIDENCE
    ratio = np.log((tally[1] + smooth) / (sizes[1] + 2 * smooth)) - np.log((tally[0] + smooth) / (sizes[0] + 2 * smooth))
    some = strong.any(1)
    return table[some], ratio[some], strong[some]


def descend(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, weigh: np.ndarray, penalty: float = 1e-4, tolerance: float = 1e-5, steps: int = 2_000) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on sparse rows, by accelerated gradient steps to convergence."""
    n = len(values)
    # a bound of the curvature: rows' squared norms
    norm = np.bincount(rows, values[columns] ** 2, len(y)).max(initial=0.0) + 1
    rate = 1.0 / (0.25 * norm * weigh.sum() + penalty)
    w, b, w0, b0 = np.zeros(n), 0.0, np.zeros(n), 0.0
    for t in range(1, steps + 1):
        push = (t - 1) / (t + 2)
        v, c = w + push * (w - w0), b + push * (b - b0)
        z = np.bincount(rows, (v * values)[columns], len(y)) + c
        g = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(columns, g[rows], n) * values + penalty * v
        gb = g.sum()
        w0, b0 = w, b
        w, b = v - rate * gw, c - rate * gb
        if max(np.abs(gw).max(initial=0.0), abs(gb)) < tolerance:
            break
    return w, float(b)


def fit(examples: list[tuple[bytes, int]]) -> dict:
    """n-gram keys, their weights up to each level and the offset; without both labels, a constant score.

    ``examples`` are packed texts (``zip_bytes`` of UTF-8) and labels. Both labels weigh alike.
    Every fifth example of a label is left for calibration.
    """
    deep = len(LEVELS)
    if len({y for _, y in examples}) < 2:
        return {"keys": np.empty(0, U64), "w": np.zeros((0, deep)), "b": 4.0 if examples and examples[0][1] else -4.0}
    turn, own, held = [0, 0], [], []
    for e in examples:
        turn[e[1]] += 1
        (held if turn[e[1]] % 5 == 0 else own).append(e)
    keys, ratio, strong = choose(own)
    table = Chosen(keys)

    def numbers(part):
        y, found = np.array([y for _, y in part], np.float64), [np.zeros((2, 0), np.int64)]
        for i, (body, _) in enumerate(part):
            _, place, level = table.features([unzip_bytes(body).decode("utf-8", "surrogatepass")])
            columns = np.concatenate([np.empty(0, np.int64), *(place[level >= k] * deep + k for k in range(deep))])
            columns = columns[strong.ravel()[columns]]
            found.append(np.stack([np.full(len(columns), i), columns]))
        return *np.concatenate(found, 1), y

    rows, columns, y = numbers(own)
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = descend(rows, columns, ratio.ravel(), y, weigh)
    w = w * ratio.ravel()
    rows, columns, y = numbers(held)
    if set(y.tolist()) == {0.0, 1.0}:
        slope, shift = calibrate(np.bincount(rows, w[columns], len(y)) + b, y)
        w, b = w * slope, b * slope + shift
    return {"keys": keys, "w": np.cumsum(np.where(strong, w.reshape(-1, deep), 0.0), 1), "b": float(b)}


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make z log odds of y, both labels weighing alike; targets are smoothed by the counts."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    weigh = np.where(y == 1, 0.5 / up, 0.5 / down)
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weigh * (target - p)))
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


class Scorer:
    def __init__(self, model: dict):
        self.chosen, self.w, self.b = Chosen(model["keys"]), model["w"], model["b"]

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, place, level = self.chosen.features(texts)
        z = np.bincount(rows, self.w[place, level], len(texts)) + self.b
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The ``keep`` columns and ``name`` (0 to 1), for every whole text.

    Null and empty texts score as one without features; repeated rows each get their score; no
    rows give no rows. A column of ``keep`` called as ``name`` is refused: choose another name.
    """
    if name in keep:
        raise ValueError(f"column {name!r} is kept and made: give another name")
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, scores, i = batch.column(batch.num_columns - 1).to_pylist(), [np.empty(0)], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= PIECE):
                    size += len(texts[j] or "")
                    j += 1
                scores.append(scorer.scores([t or "" for t in texts[i:j]]))
                i = j
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(scores), pa.float64())], names=[*keep, name])

    own = docs.select(*keep)
    rows = docs.select(*keep, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))
