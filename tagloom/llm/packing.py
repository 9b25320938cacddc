"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

1. Documents are tokenised, closed by a separator and, where longer than a sequence,
   cut; the pieces are written with their token ids.
2. Pieces of equal length are interchangeable, so a plan needs only how many pieces
   there are of each length: ``capacity`` numbers, whatever the corpus.
3. Bins are planned one pattern at a time: the longest remaining length is taken, a
   subset-sum dynamic programme over bit sets of the remaining lengths (with their
   counts) finds the fullest feasible rest, and the pattern is repeated as often as the
   counts allow. Each pattern uses up a length or nearly so, so patterns are few.
4. A piece's place follows from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

CACHE = 250_000
CHUNK_BYTES = 2 << 20
#: Rows of (task, length, count) that are broadcast; a larger table is joined by shuffle.
BROADCAST_ROWS = 1_000_000


#: ASCII punctuation that makes one piece with its like after letters; an apostrophe may begin a suffix.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Token ids of texts, by the words between ASCII spaces.

    The tokenizer's normaliser and splitter never join what white space parts, so ids of a
    text are those of its words in order. A word of Latin letters, with marks at its end or
    not, is one letter piece and one mark piece, which the model can be asked for directly;
    any other word goes through the whole tokenizer. Pieces seen lately are kept in two
    bounded generations.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words, self.words_before = {}, {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.direct = all(self._letters(w) == self._whole(w) for w in ("the", "naïve", "straße", "über"))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _letters(self, core: str) -> bytes:
        raw = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        found = self.model.tokenize(raw)
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else array("I", [t.id for t in found]).tobytes()

    def _piece(self, text: str, latin: bool) -> bytes:
        ids = self.young.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is None:
                ids = self._letters(text) if latin and self.direct else self._whole(text)
            self.young[text] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text.isascii():
            low = text.lower()
            return self.young.get(low) or self._piece(low, True)
        core = text.rstrip(MARKS)
        # up to U+017F letters have one lower case each and no loose combining forms, but for the dotted I
        if not core.isalpha() or not core.isascii() and (max(core) > "\u017f" or "\u0130" in core or "\u0149" in core):
            return self._piece(text, False)
        ids = self._piece(core.lower(), True)
        return ids + self._piece(text[len(core) :], False) if len(core) < len(text) else ids

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split() for t in texts]
        known, before, piece = self.words, self.words_before, self._word
        for w in set().union(*split) - known.keys() if split else ():
            known[w] = before.get(w) or piece(w)
        for words in split:
            yield b"".join(map(known.__getitem__, words))
        if len(known) > CACHE:
            self.words, self.words_before = {}, known
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}


PIECE = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, closing: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, rank, doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece.

    ``part`` is the task that made it, ``rank`` its number among that task's pieces of its length.
    """

    def run(batches):
        coder, part, ranks = WordTokens(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = b"" if closing is None else np.array([closing], np.uint32).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
                    size += len(texts[j])
                    j += 1
                out = {c: [] for c in PIECE.names}
                for d, ids in zip(doc_ids[i:j], coder.encode(texts[i:j])):
                    ids += end
                    n = len(ids) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - s)
                        for c, v in zip(PIECE.names, (part, ranks[length], d, p, s, length, ids[4 * s : 4 * (s + capacity)])):
                            out[c].append(v)
                        ranks[length] += 1
                yield pa.RecordBatch.from_pydict(out, PIECE)
                i = j

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "part int, rank long, doc_id long, piece int, start long, length long, ids binary")


def _fullest(counts: list[int], room: int) -> list[int]:
    """Lengths, with counts, whose sum is the greatest at most ``room``; the longest are preferred."""
    full, states, reached, mask = 1 << room, [], 1, (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        copies, block = min(counts[length], room // length), 1
        if not copies:
            continue
        states.append((length, copies, reached))
        while copies:  # copies in binary: 1, 2, 4, ... and the rest
            take = min(block, copies)
            reached |= (reached << (take * length)) & mask
            copies -= take
            block *= 2
        if reached & full:
            break
    rest, chosen = reached.bit_length() - 1, []
    for length, copies, before in reversed(states):
        used = 0
        while not (before >> rest) & 1:
            rest -= length
            used += 1
        chosen += [length] * used
    return chosen


def plan(counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, ranks, first sequence, offset) segments and the number of sequences.

    ``counts[n]`` is the number of pieces of length n. Each segment gives the piece of rank
    ``first rank + i`` of its length the sequence ``first sequence + i`` at ``offset``.
    """
    counts, taken, segments, sequence = counts[:], [0] * len(counts), [], 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return segments, sequence
        counts[longest] -= 1
        pattern = [longest, *_fullest(counts, capacity - longest)]
        counts[longest] += 1
        uses = {n: pattern.count(n) for n in set(pattern)}
        times = min(counts[n] // k for n, k in uses.items())
        offset = 0
        for n in pattern:
            segments.append((n, taken[n], times, sequence, offset))
            taken[n] += times
            counts[n] -= times
            offset += n
        sequence += times


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int | None = 0, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every row.

    A null or empty text is only its closing id (no piece if ``closing`` is None). Rows with
    a null or a repeated doc_id are packed each for itself. No rows give no pieces. Extra
    columns of ``docs`` are not read. Every sequence is filled without gaps from 0.
    """
    space = space or Workspace(docs.sparkSession, "packing")
    pieces = space.write(tokenised(docs, tokenizer, capacity, closing, id_col, text_col), "pieces")
    # at most capacity rows a task
    tally = space.write(pieces.groupBy("part", "length").count(), "tally")
    counts = [0] * (capacity + 1)
    for r in tally.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[r["length"]] = r["n"]
    segments, _ = plan(counts, capacity)
    ahead = tally.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("ahead"))
    if tally.count() <= BROADCAST_ROWS:
        ahead = F.broadcast(ahead)
    table = docs.sparkSession.createDataFrame(segments, "length long, low long, times long, first long, offset long")
    # segments number at most a few for each length, whatever the input
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead")).alias("p")
    inside = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("times"))
    placed = ranked.join(F.broadcast(table).alias("s"), inside)
    return placed.select("doc_id", "piece", "start", "p.length", "ids", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
