"""A parallel scan of texts by a small automaton.

A piece of a text is summed up by a function: for each state it may be entered in, the state
it is left in and how many units end inside. Such functions compose associatively, so pieces
are scanned without knowing what comes before them, and the state that each was really
entered in is found afterwards. Here pieces are lanes of LANE bytes, all walked side by side
in numpy; ``tagloom.llm.fim`` uses the same functions for pieces of a giant text that lie in
different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LANE = 256
#: Lanes that are walked at once; they bound the memory of a scan.
LANES = 1 << 14


class Automaton:
    """Units of a text, by states over classes of bytes.

    ``step[state][class]`` is the next state, ``ends[state][class]`` whether a unit ends right
    after that byte, ``pending[state]`` whether the end of the text closes one. State 0 is
    where a text begins.
    """

    def __init__(self, classes: np.ndarray, step: list[list[int]], ends: list[list[int]], pending: list[int]):
        self.states, self.pad = len(step), len(step[0])
        self.classes = np.asarray(classes, np.uint8)
        # one class more, for the bytes that fill a lane: it changes nothing
        self.step = np.array([[*row, s] for s, row in enumerate(step)], np.uint8).ravel()
        self.ends = np.array([[*row, 0] for row in ends], np.uint8).ravel()
        self.pending = np.array(pending, np.int64)
        self.width = self.pad + 1


def _classes(of: dict[int, int], rest: int) -> np.ndarray:
    table = np.full(256, rest, np.uint8)
    for byte, kind in of.items():
        table[byte] = kind
    return table


#: Lines, each with its newline: ``[^\\n]*\\n|[^\\n]+``. State 1: inside a line.
LINES = Automaton(_classes({10: 0}, 1), [[0, 1], [0, 1]], [[1, 0], [1, 0]], [0, 1])
#: Paragraphs, each with the two newlines that close it: ``(?s).*?\\n\\n|.+``. State 1: inside, 2: after one newline.
PARAGRAPHS = Automaton(_classes({10: 0}, 1), [[2, 1], [2, 1], [0, 1]], [[0, 0], [0, 0], [1, 0]], [0, 1, 1])
UNITS = {"lines": LINES, "paragraphs": PARAGRAPHS}


class Scan:
    """Units of many texts. ``offsets`` are the n + 1 bounds of the texts in ``data`` (bytes as uint8)."""

    def __init__(self, automaton: Automaton, data: np.ndarray, offsets: np.ndarray):
        self.auto, sizes = automaton, np.diff(offsets)
        self.sizes, self.lanes = sizes, np.maximum(1, -(-sizes // LANE))
        self.first = np.concatenate(([0], np.cumsum(self.lanes)))
        total, s = int(self.first[-1]), automaton.states
        place = np.arange(int(sizes.sum())) + np.repeat(self.first[:-1] * LANE - (offsets[:-1] - offsets[0]), sizes)
        part = data[offsets[0] : offsets[-1]]
        filled = np.full(total * LANE, automaton.pad, np.uint8)
        filled[place] = automaton.classes[part]
        self.marks = filled.reshape(total, LANE)
        points = np.zeros(total * LANE, np.uint8)
        points[place] = (part & 0xC0) != 0x80
        self.points = points.reshape(total, LANE)
        to, counts = self._walk(np.repeat(np.arange(s, dtype=np.uint8), total).reshape(s, total))
        self.to, self.counts = self._composed(to.T.astype(np.int64), counts.T.astype(np.int64))
        self.chars = np.cumsum(self.points.sum(axis=1, dtype=np.int64))

    def _walk(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns, counts = np.ascontiguousarray(self.marks.T), np.zeros(state.shape, np.uint16)
        for c in columns:
            at = state * np.uint8(self.auto.width) + c
            counts += self.auto.ends[at]
            state = self.auto.step[at]
        return state, counts

    def _composed(self, to: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions of each lane and all those before it in its text: a scan in log2(lanes of a text) steps."""
        place = np.arange(len(to)) - np.repeat(self.first[:-1], self.lanes)
        far = 1
        while far < self.lanes.max(initial=0):
            late = np.flatnonzero(place >= far)
            mid = to[late - far]
            new_to, new_counts = np.take_along_axis(to[late], mid, 1), counts[late - far] + np.take_along_axis(counts[late], mid, 1)
            to[late], counts[late] = new_to, new_counts
            far *= 2
        return to, counts

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: state left in and units ended, by state entered in; its code points."""
        last = self.first[1:] - 1
        return self.to[last], self.counts[last], self.chars[last] - np.where(self.first[:-1] > 0, self.chars[self.first[:-1] - 1], 0)

    def units(self) -> np.ndarray:
        """Units of each text, entered in state 0 and closed by its end."""
        to, counts, _ = self.functions()
        return counts[:, 0] + self.auto.pending[to[:, 0]]

    def ends_of(self, wanted: np.ndarray, entered: np.ndarray | None = None) -> np.ndarray:
        """Code points up to the end of unit ``wanted[t]`` of each text t: 0 for unit 0, all of them if the text's end closes it."""
        n = len(self.sizes)
        entered = np.zeros(n, np.int64) if entered is None else entered
        lane_text = np.repeat(np.arange(n), self.lanes)
        upto, left = self.counts[np.arange(len(lane_text)), entered[lane_text]], self.to[np.arange(len(lane_text)), entered[lane_text]]
        base = np.concatenate(([0], np.cumsum(upto[self.first[1:] - 1])[:-1])) if n else np.zeros(0, np.int64)
        before = np.where(self.first[:-1] > 0, self.chars[self.first[:-1] - 1], 0)
        out = self.chars[self.first[1:] - 1] - before  # closed by the end, unless found inside
        out[wanted == 0] = 0
        inside = np.flatnonzero((wanted > 0) & (wanted <= upto[self.first[1:] - 1]))
        if not len(inside):
            return out
        lane = np.searchsorted(upto + base[lane_text], base[inside] + wanted[inside])
        head = lane == self.first[inside]
        state = np.where(head, entered[inside], left[lane - 1]).astype(np.uint8)
        need = wanted[inside] - np.where(head, 0, upto[lane - 1])
        done, seen, chars = np.zeros(len(lane), bool), np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        for c, p in zip(np.ascontiguousarray(self.marks[lane].T), np.ascontiguousarray(self.points[lane].T)):
            at = state * np.uint8(self.auto.width) + c
            chars += np.where(done, 0, p)
            seen += self.auto.ends[at]
            done |= seen >= need
            state = self.auto.step[at]
        out[inside] = chars + np.where(lane > 0, self.chars[lane - 1], 0) - before[inside]
        return out


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some LANES lanes together, a longer text alone."""
    lanes, i, n = np.maximum(1, -(-np.diff(offsets) // LANE)), 0, len(offsets) - 1
    ends = np.cumsum(lanes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LANES, "right")))
        yield i, j
        i = j
