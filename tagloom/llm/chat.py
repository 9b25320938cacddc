"""Chat formatting by event sourcing: logs are folded into final messages, then rendered.

Events have a conversation, a turn, a sequence number and a kind:

* ``message`` begins a message of the turn, with its role and text;
* ``delta`` appends streamed text to the turn's last message;
* ``edit`` replaces that message's text; ``regenerate`` empties it for new deltas.
  Both also discard the later turns begun before them.

Rendering marks turns and escapes control characters inside roles and texts with a
backslash, so that ``parse`` gives back what was rendered, whatever it contained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import importable

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_text = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<"})
_role = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<", ":": "\\:"})

KINDS = ("message", "delta", "edit", "regenerate")
MESSAGE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("begun", pa.int64()), ("cut", pa.int64())])
RENDERED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's marked text and where its escaped text lies in it."""
    head = OPEN + role.translate(_role) + COLON
    body = text.translate(_text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def unescape(s: str) -> str:
    out, i = [], s.find("\\")
    if i < 0:
        return s
    last = 0
    while i >= 0:
        out.append(s[last:i])
        out.append(s[i + 1 : i + 2])
        last = i + 2
        i = s.find("\\", last)
    return "".join([*out, s[last:]])


def _bare(s: str, mark: str, start: int) -> int:
    """Index of the first ``mark`` at or after start whose first character is not escaped."""
    i = s.index(mark, start)
    while True:
        k = i
        while k > start and s[k - 1] == "\\":
            k -= 1
        if (i - k) % 2 == 0:
            return i
        i = s.index(mark, i + 1)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        colon = _bare(formatted, COLON, at + len(OPEN))
        close = _bare(formatted, CLOSE[1:], colon + len(COLON)) - 1
        yield unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(COLON) : close])
        at = close + len(CLOSE)


def _stream(batches, columns):
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000):
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Messages of (conv_id, turn, seq, kind, role, text) rows in that order; one turn's messages are held at a time."""
    here, held, cut = None, [], None

    def done():
        for pos, (role, parts, begun) in enumerate(held):
            yield (*here, pos, role, "".join(parts), begun, cut)

    for conv, turn, seq, kind, role, text in rows:
        if (conv, turn) != here:
            yield from done()
            here, held, cut = (conv, turn), [], None
        if kind == "message" or not held:
            held.append([role or "", [text or ""], seq])
        elif kind == "delta":
            held[-1][1].append(text or "")
        else:
            held[-1][0] = role or held[-1][0]
            held[-1][1], held[-1][2] = [text or ""], seq
        if kind in ("edit", "regenerate"):
            cut = seq
    yield from done()


def rendered(rows: Iterator[tuple], loss_role: str) -> Iterator[tuple]:
    """Rendered turns of messages ordered by conversation, turn and position; ``start`` is the offset in the conversation."""
    here, start, discard, turn_now, pending = object(), 0, None, None, None
    for conv, turn, pos, role, text, begun, cut in rows:
        if conv != here:
            here, start, discard, turn_now, pending = conv, 0, None, None, None
        if turn != turn_now:
            if pending is not None:
                discard = pending if discard is None else max(discard, pending)
            turn_now, pending = turn, None
        if cut is not None:
            pending = cut
        if discard is not None and begun is not None and begun < discard:
            continue
        out, low, high = render(role, text)
        loss = role == loss_role
        yield conv, turn, pos, start, out, low if loss else None, high if loss else None
        start += len(out)


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, pos, start, formatted, loss_start, loss_end: each final turn, rendered.

    The conversation's text is its ``formatted`` pieces in order, ``start`` being a piece's
    offset; loss_start and loss_end bound the escaped text under the loss mask inside the
    piece. Input columns conv_id, turn, seq, kind, role, text; an unknown or null kind counts
    as ``message``, null role or text as empty; repeated messages of a turn are kept, equal
    seq being ordered by role and text. Null conv_ids form one conversation. Extra columns are
    not read. Turns are folded where their own hash lies, so that a conversation with many
    events is shared out; only its final messages meet, and are streamed in order, never held.
    Rows leave sorted by conv_id, turn, pos inside each partition.
    """
    importable(events.sparkSession)
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message")
    rows = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), kind.alias("kind"), F.col("role").cast("string"), F.col("text").cast("string"))
    by_turn = rows.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    folded = by_turn.mapInArrow(lambda b: _emit(fold(_stream(b, ("conv_id", "turn", "seq", "kind", "role", "text"))), MESSAGE), "conv_id long, turn long, pos long, role string, text string, begun long, cut long")
    ordered = folded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "pos")
    return ordered.mapInArrow(lambda b: _emit(rendered(_stream(b, MESSAGE.names), loss_role), RENDERED, 500), "conv_id long, turn long, pos long, start long, formatted string, loss_start long, loss_end long")


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its rendered text says: turns and loss text, digested as they stream by."""

    def digest(rows):
        here, state = object(), None
        for conv, piece, low, high in rows:
            if conv != here:
                if state:
                    yield here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if low is not None:
                loss = unescape(piece[low:high])
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += len(piece)
        if state:
            yield here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    return formatted.mapInArrow(lambda b: _emit(digest(_stream(b, ("conv_id", "formatted", "loss_start", "loss_end"))), READ), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
