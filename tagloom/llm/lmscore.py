"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

Counts. Every block of texts sends its distinct words once with their counts in training
texts, and is answered with the corpus counts (``blocks.py``); what is exchanged grows with
the corpus. Texts become sequences of word numbers with those counts.

Model. A word of the training texts belongs to a class, the band of its count (powers of
eight) and a trait of its spelling, and to one of SLOTS slots of its class, by hash. All other
words are class 0. P(word | history) = P(class | history) * P(slot | class, history) *
P(word | class, slot). The first two factors are softmaxes over the weights of hashed features
of the history (the last word, a skip to the last common word however far back, and, for classes,
the classes of the last two words), on top of the factor's distribution without any history; the
third is the word's share of its slot. A word of class 0 has, in place of the second and third,
the probability of its spelling under a model of bytes and up to ORDERS bytes before them, learned
from words that occur once. So the probabilities of all words sum to one, but for what the spelling
model gives to words of the training texts.

Training. In each of ROUNDS, tasks take gradient steps (AdaGrad, minibatches of whole numpy
arrays) from the shared weights, each over its own blocks; of each row of weights the changes
are averaged by how many words each task saw with it. A training word's own occurrence is taken
off its count, so that class 0 has a probability to learn from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answer_keys, buckets, send_keys, with_answers, write_blocks
from .textkit import FOLDED, SPACE, U64, Texts, mix, pack_ints, pack_keys, unpack_ints, unpack_keys, unzip_bytes, zip_bytes
from .workspace import Workspace

BANDS, TRAITS, SLOTS = 8, 4, 64
CLASSES = 1 + BANDS * TRAITS
#: Rows of weights for each kind of history are 2 ** bits; bits follow the distinct words, up to the last of these.
BITS = (8, 15)
ROUNDS = 3
#: Blocks of a round that one task trains on, so that tasks follow the input and not the cores.
TASK_BLOCKS = 24
BATCH = 8_192
RATE, CAUTION = 0.35, 0.3
#: A word is common from this share of all training words on.
COMMON = 2.0**-12
END = U64(0x0E4D_0E4D_0E4D_0E4D)
START = U64(0x57A7_57A7_57A7_57A7)
END_TRAIT = 0
SLICES = 16
NEVER = np.float32(-1e9)
LOWER = np.arange(256)
LOWER[65:91] += 32
#: Bytes that a word can hold, and its end.
SYMBOLS = int((~SPACE).sum()) + 1
ORDERS = 3
#: Rows of the spelling table: one without context, one for each byte before, and hashed ones for two and three bytes.
HASHED = 1 << 13
SPELLING_ROWS = 1 + 257 + (ORDERS - 1) * HASHED


def in_training(doc_id: int | None, modulus: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus != held


def band(count: np.ndarray) -> np.ndarray:
    """0 for unseen, else 1 + log8 of the count, at most BANDS."""
    c = np.maximum(count, 1).astype(np.float64)
    return np.where(count <= 0, 0, np.minimum(BANDS, 1 + (np.log2(c) / 3 + 1e-12).astype(np.int64)))


def class_of(count: np.ndarray, trait: np.ndarray) -> np.ndarray:
    level = band(count)
    return np.where(level == 0, 0, 1 + (level - 1) * TRAITS + trait)


def slot_of(key: np.ndarray) -> np.ndarray:
    return (mix(key + U64(77)) % U64(SLOTS)).astype(np.int64)


def _words(block: Block, known: np.ndarray) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts; word keys with each text's end, their text, traits; sizes; which words are in training texts."""
    t = Texts(block.texts, FOLDED)
    sizes = t.n_words + 1
    ends = np.cumsum(sizes) - 1
    key = np.full(int(sizes.sum()), END, U64)
    body = np.ones(len(key), bool)
    body[ends] = False
    key[body] = t.key
    trait = np.full(len(key), END_TRAIT, np.int64)
    last = FOLDED[0][t.data[np.maximum(t.ends - 1, 0)]] if len(t.key) else np.empty(0, U64)
    trait[body] = (mix(last) >> U64(62)).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return t, key, trait, doc, sizes, known[doc]


def _known(block: Block, modulus: int, held: int) -> np.ndarray:
    return np.array([in_training(i, modulus, held) for i in block.doc_ids()], bool)


def _combine(slot: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(slot, vals >> 2, n).astype(np.int64)
    trait = np.zeros(n, np.int64)
    trait[slot] = vals & 3
    return count << 2 | trait


def _summary(keys: np.ndarray, found: np.ndarray) -> bytes:
    """Training words; distinct ones; words of each class, own occurrences taken off; smoothed words of each slot."""
    count, trait = found >> 2, found & 3
    seen = count > 0
    count, trait = count[seen], trait[seen]
    classes = np.bincount(class_of(count - 1, trait), count, CLASSES)
    slots = np.bincount(class_of(count, trait) * SLOTS + slot_of(keys[seen]), count + 1, CLASSES * SLOTS)
    return pack_ints(np.concatenate(([count.sum(), seen.sum()], classes, slots)).astype(np.int64))


def spellings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some words, for each byte and the end (256): codes of it after its last 0 to ORDERS bytes (256 before the start), and the word."""
    sizes = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, held = starts[word] + place, np.append(data, 0)
    back = [np.where(place >= k, LOWER[held[np.clip(at - k, 0, len(data))]], 256) for k in range(ORDERS + 1)]
    symbol = np.where(place == sizes[word] - 1, 256, back[0])
    rows, key = [np.zeros(len(word), np.int64), 1 + back[1]], back[1].astype(U64)
    for k in range(2, ORDERS + 1):
        key = mix(key + back[k].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(k))
        rows.append(258 + (k - 2) * HASHED + (key % U64(HASHED)).astype(np.int64))
    return np.stack(rows, 1) * 257 + symbol[:, None], word


TOKENS_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "sizes", "keys", "counts", "words", "codes", "times", "odd", "of"))])
TOKENS = ", ".join(f"{f.name} {'long' if f.name == 'block' else 'binary'}" for f in TOKENS_ARROW)


def _pack_small(v: np.ndarray) -> bytes:
    return zip_bytes(np.ascontiguousarray(v.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_small(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip_bytes(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


class Sizes:
    """What the counts settle: training words, distinct ones, rows of weights, distributions without history."""

    def __init__(self, sums: np.ndarray):
        self.n, self.v = int(sums[0]), int(sums[1])
        classes, mass = sums[2 : 2 + CLASSES].astype(np.float64), sums[2 + CLASSES :].astype(np.float64)
        self.bits = int(min(BITS[1], max(BITS[0], np.ceil(np.log2(self.v + 1)) - 3)))
        self.common = max(1.0, self.n * COMMON)
        self.mass = mass
        table = mass.reshape(CLASSES, SLOTS)
        real = table.sum(1) > 0
        real[0] = True
        #: log distribution of classes, and of slots in each class; what holds no word is never chosen
        share = np.where(real, classes + 0.5, 0)
        with np.errstate(divide="ignore"):
            self.of_class = np.maximum(np.log(share / share.sum()), NEVER).astype(np.float32)
            self.of_slot = np.maximum(np.log(table / np.maximum(table.sum(1, keepdims=True), 1)), NEVER).astype(np.float32)
        self.shapes = ((2 * (1 << self.bits) + (CLASSES + 1) ** 2, CLASSES), (2 * (1 << self.bits), SLOTS))


class Tokens:
    """A block as word numbers: per token key, count, trait, slot and text."""

    def __init__(self, row: dict):
        self.ids, self.known = unpack_ints(row["ids"]), unpack_ints(row["known"]).astype(bool)
        self.sizes = unpack_ints(row["sizes"])
        self.words = _unpack_small(row["words"])
        self.keys, found = unpack_keys(row["keys"]), unpack_ints(row["counts"])
        self.slot = slot_of(self.keys)[self.words]
        self.key, self.count, self.trait = self.keys[self.words], found[self.words] >> 2, found[self.words] & 3
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.odd, self.of = unpack_ints(row["odd"]), unpack_ints(row["of"])

    def doc_ids(self) -> list:
        return [i if k else None for i, k in zip(self.ids.tolist(), self.known.tolist())]

    def history(self, classes: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both tables of weights for each token; the second's are of the token's class too."""
        n = len(self.key)
        one = np.empty(n, U64)
        one[1:] = self.key[:-1]
        begin = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        place = np.arange(n) - begin
        one[place < 1] = START
        often = np.maximum.accumulate(np.where((self.count >= sizes.common) & (self.key != END), np.arange(n), -1))
        often = np.append(-1, often[:-1])[:n]
        common = np.where(often >= begin, self.key[np.maximum(often, 0)], START) if n else one
        c1, c2 = np.full(n, CLASSES), np.full(n, CLASSES)
        c1[1:], c2[2:] = classes[:-1], classes[:-2]
        c1[place < 1], c2[place < 2] = CLASSES, CLASSES
        shift, size = U64(64 - sizes.bits), 1 << sizes.bits
        row = lambda key: (mix(key) >> shift).astype(np.int64)
        last, far = mix(one), common * U64(3)
        own = (classes.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        first = np.stack([row(one), size + row(far + U64(1)), 2 * size + c1 * (CLASSES + 1) + c2], 1)
        return first, np.stack([row(last ^ own), size + row(far + own)], 1)


def chance(w: np.ndarray, rows: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Softmax of each token's rows of weights on top of ``plain``."""
    z = w[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += w[rows[:, k]]
    z += plain
    # weights stay far below what overflows, and every row has a class of its own distribution near 0
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    z /= np.maximum(z @ np.ones(z.shape[1], z.dtype), np.float32(1e-37))[:, None]
    return z


def steps(w: np.ndarray, speed: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray, plain) -> None:
    """One pass of AdaGrad steps over (rows, target), in place; ``plain(i, j)`` are the distributions of tokens i to j."""
    first = rows.min(0, initial=1 << 62)
    for i in range(0, len(rows), BATCH):
        r, y = rows[i : i + BATCH], target[i : i + BATCH]
        g = chance(w, r, plain(i, i + BATCH))
        g[np.arange(len(y)), y] -= 1
        for k in range(r.shape[1]):
            near = r[:, k] - first[k]
            # 16-bit numbers are sorted by radix
            order = np.argsort(near.astype(np.uint16) if BITS[1] <= 16 else near, kind="stable")
            sorted_rows = r[order, k]
            edges = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
            at = sorted_rows[edges]
            total = np.add.reduceat(g[order], edges, axis=0)
            pace = speed[at]
            pace += total * total
            speed[at] = pace
            np.sqrt(pace, out=pace)
            total /= pace
            total *= np.float32(RATE)
            w[at] -= total
            seen[at] += np.diff(np.append(edges, len(r)))


def _teach(tables, speeds, counts, t: Tokens, use: np.ndarray, sizes: Sizes) -> None:
    """Steps over a block's training words."""
    classes = class_of(t.count - use, t.trait)
    one, two = t.history(classes, sizes)
    some = np.flatnonzero(use & (sizes.of_class[classes] > NEVER))
    steps(tables[0], speeds[0], counts[0], one[some], classes[some], lambda i, j: sizes.of_class[None])
    some = np.flatnonzero(use & (classes > 0) & (sizes.of_slot[classes, t.slot] > NEVER))
    own = classes[some]
    steps(tables[1], speeds[1], counts[1], two[some], t.slot[some], lambda i, j: sizes.of_slot[own[i:j]])


UPDATE = pa.schema([("slice", pa.int32()), ("which", pa.int32()), ("rows", pa.binary()), ("seen", pa.binary()), ("change", pa.binary())])


def _train(tokens: DataFrame, turn: int, tables: list[np.ndarray], sizes: Sizes, n_blocks: int, modulus: int, held: int) -> list[np.ndarray]:
    """The weights after a round. Tasks send the rows that they changed, in half precision and compressed."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((tables, sizes))

    def bounds(which: int, s: int) -> tuple[int, int]:
        rows = sizes.shapes[which][0]
        return rows * s // SLICES, rows * (s + 1) // SLICES

    def run(batches):
        before, sizes = shared.value
        now, speeds = [w.copy() for w in before], [np.full(w.shape, CAUTION, np.float32) for w in before]
        counts = [np.zeros(len(w), np.int64) for w in before]
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row)
                use = np.array([in_training(i, modulus, held) for i in t.doc_ids()], bool)[t.doc]
                if use.any():
                    _teach(now, speeds, counts, t, use, sizes)
        for which in (0, 1):
            for s in range(SLICES):
                low, high = bounds(which, s)
                at = low + np.flatnonzero(counts[which][low:high])
                if len(at):
                    change = (now[which][at] - before[which][at]).astype(np.float16)
                    row = {"slice": s, "which": which, "rows": pack_ints(at - low), "seen": pack_ints(counts[which][at]), "change": zip_bytes(change.tobytes())}
                    yield pa.RecordBatch.from_pylist([row], UPDATE)

    def average(batches):
        """A slice's changes, added up as they come: no more is held than the slice."""
        sums, counts, s = {}, {}, None
        for batch in batches:
            for r in batch.to_pylist():
                which, s = r["which"], r["slice"]
                low, high = bounds(which, s)
                if which not in sums:
                    sums[which], counts[which] = np.zeros((high - low, sizes.shapes[which][1])), np.zeros(high - low)
                at, seen = unpack_ints(r["rows"]), unpack_ints(r["seen"])
                sums[which][at] += np.frombuffer(unzip_bytes(r["change"]), np.float16).reshape(len(at), -1) * seen[:, None].astype(np.float64)
                counts[which][at] += seen
        for which, total in sums.items():
            at = np.flatnonzero(counts[which])
            change = (total[at] / counts[which][at, None]).astype(np.float16)
            yield pa.RecordBatch.from_pylist([{"slice": s, "which": which, "rows": pack_ints(at), "seen": None, "change": zip_bytes(change.tobytes())}], UPDATE)

    schema = "slice int, which int, rows binary, seen binary, change binary"
    tasks = max(1, -(-n_blocks // (ROUNDS * TASK_BLOCKS)))
    share = tokens.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn).coalesce(tasks)
    tables = [w.copy() for w in tables]
    # the weights, of bounded size
    for r in share.mapInArrow(run, schema).repartitionById(SLICES, F.col("slice")).mapInArrow(average, schema).toLocalIterator():
        low, at = bounds(r["which"], r["slice"])[0], unpack_ints(bytes(r["rows"]))
        tables[r["which"]][low + at] += np.frombuffer(unzip_bytes(bytes(r["change"])), np.float16).reshape(len(at), -1)
    return tables


class Spelling:
    """P(byte or end | bytes before): counts of the longer context on top of the shorter one's probabilities."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        table = counts.reshape(-1, 257)
        self.total, self.kinds = table.sum(1), (table > 0).sum(1).astype(np.float64)

    def log_chance(self, codes: np.ndarray) -> np.ndarray:
        """log10 for rows of codes, one for each order."""
        p = np.full(len(codes), 1.0 / SYMBOLS)
        for k in range(codes.shape[1]):
            row = codes[:, k] // 257
            weight = self.total[row] + self.kinds[row]
            p = np.where(weight > 0, (self.counts[codes[:, k]] + self.kinds[row] * p) / np.maximum(weight, 1), p)
        return np.log10(p)


def spelling(tokens: DataFrame) -> Spelling:
    """The spelling model of the words that occur once."""

    def add(batches):
        total = np.zeros(SPELLING_ROWS * 257, np.int64)
        for batch in batches:
            for codes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[unpack_ints(codes)] += unpack_ints(times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["code", "n"])

    counts = np.zeros(SPELLING_ROWS * 257)
    # at most one row a code
    found = tokens.select("codes", "times").mapInArrow(add, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return Spelling(counts)


def log_chances(t: Tokens, classes: np.ndarray, tables: list[np.ndarray], sizes: Sizes, spelled: np.ndarray) -> np.ndarray:
    """log10 P(word | history) of each token."""
    one, two = t.history(classes, sizes)
    out = np.empty(len(classes))
    for i in range(0, len(classes), BATCH):
        c, s = classes[i : i + BATCH], t.slot[i : i + BATCH]
        each = np.arange(len(c))
        p = chance(tables[0], one[i : i + BATCH], sizes.of_class[None])[each, c]
        inside = chance(tables[1], two[i : i + BATCH], sizes.of_slot[c])[each, s]
        out[i : i + BATCH] = np.log10(np.maximum(p, 1e-30)) + np.where(c > 0, np.log10(np.maximum(inside, 1e-30)), 0.0)
    share = np.log10((t.count + 1) / np.maximum(sizes.mass[classes * SLOTS + t.slot], 1))
    return out + np.where(classes > 0, share, spelled[t.words])


def spelled_words(t: Tokens, model: Spelling) -> np.ndarray:
    """log10 of the spelling's probability for each distinct word of a block that is in no training text, else 0."""
    return np.bincount(t.of, model.log_chance(t.odd.reshape(-1, ORDERS + 1)), len(t.keys)) if len(t.of) else np.zeros(len(t.keys))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("known_base", pa.float64()), ("known_score", pa.float64())])


def tokenised(docs: DataFrame, modulus: int, held: int, id_col: str, text_col: str, space: Workspace) -> tuple[DataFrame, Sizes, int]:
    """The written table of numbered words, what the counts settle, and the number of blocks."""
    blocks = write_blocks(docs, space, id_col, text_col)

    def count(block: Block) -> tuple[np.ndarray, np.ndarray]:
        _, key, trait, _, _, use = _words(block, _known(block, modulus, held))
        order = np.argsort(key, kind="stable")
        keys = key[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.add.reduceat(use[order].astype(np.int64), at) << 2 | trait[order][at]

    n = buckets(blocks)
    answers = space.write(answer_keys(send_keys(blocks, n, count), n, _combine, _summary), "counts", "uncompressed")
    # one row for each range of keys
    sums = np.zeros(2 + CLASSES + CLASSES * SLOTS, np.int64)
    for r in answers.filter("block < 0").select("keys").toLocalIterator():
        sums += unpack_ints(bytes(r["keys"]))

    def number(block: Block, found: np.ndarray) -> list[dict]:
        t, key, _, doc, sizes, use = _words(block, _known(block, modulus, held))
        keys, first, words = np.unique(key, return_index=True, return_inverse=True)
        # a token's place among the texts' words: ends are no words
        place = first - doc[first]

        def spans(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ended = keys[which] == END
            at = np.minimum(place[which], max(0, len(t.starts) - 1))
            starts = np.where(ended, 0, t.starts[at]) if len(t.starts) else np.zeros(len(which), np.int64)
            return starts, np.where(ended, 0, t.ends[at]) if len(t.starts) else starts

        trained = np.zeros(len(keys), bool)
        trained[words[use]] = True
        once, never = np.flatnonzero((found >> 2 == 1) & trained), np.flatnonzero(found >> 2 == 0)
        codes, times = np.unique(spellings(t.data, *spans(once))[0].ravel(), return_counts=True)
        odd, of = spellings(t.data, *spans(never))
        made = {"ids": block.ids, "known": block.known, "sizes": sizes, "counts": found, "codes": codes, "times": times, "odd": odd.ravel(), "of": never[of]}
        return [{"block": block.block, "keys": pack_keys(keys), "words": _pack_small(words)} | {c: pack_ints(v) for c, v in made.items()}]

    tokens = space.write(with_answers(blocks, answers, number, TOKENS, TOKENS_ARROW), "tokens", "uncompressed")
    space.drop("blocks")
    space.drop("counts")
    return tokens, Sizes(sums), tokens.count()


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_base, known_score of every row.

    Texts whose crc32(doc_id as text) mod ``modulus`` is ``held`` are held out of training, as
    are rows without a doc_id (held_out false). A null or empty text is its end token alone.
    Repeated rows count each time. Without any training text every word is of class 0: the base
    is log10(1 / 1) a token, and the score that of its spelling. No rows give no rows. Extra
    columns are not read. known_base and known_score are the parts of both scores that words of
    the training texts have. The weights depend on which blocks meet in a task, so on how the
    input is split, but not on how many cores there are for large inputs.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark, "lmscore")
    tokens, sizes, n_blocks = tokenised(docs, modulus, held, id_col, text_col, space)
    tables = [np.zeros(shape, np.float32) for shape in sizes.shapes]
    for turn in range(ROUNDS):
        tables = _train(tokens, turn, tables, sizes, n_blocks, modulus, held)
    shared = spark.sparkContext.broadcast((tables, sizes, spelling(tokens)))

    def score(batches) -> Iterator[pa.RecordBatch]:
        tables, sizes, letters = shared.value
        low = np.log10(sizes.n + sizes.v + 1.0)
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row)
                model = log_chances(t, class_of(t.count, t.trait), tables, sizes, spelled_words(t, letters))
                base = np.log10(t.count + 1.0) - low
                d, ids, known = len(t.sizes), t.doc_ids(), t.count > 0
                outside = [i is not None and not in_training(i, modulus, held) for i in ids]
                sums = (np.bincount(t.doc, x, d) for x in (base, model, base * known, model * known))
                columns = (ids, outside, t.sizes, np.bincount(t.doc, known, d).astype(np.int64), [sizes.n] * d, *sums)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, SCORED.types)], schema=SCORED)

    names = {"int64": "long", "bool": "boolean", "double": "double"}
    return tokens.mapInArrow(score, ", ".join(f"{f.name} {names[str(f.type)]}" for f in SCORED))
