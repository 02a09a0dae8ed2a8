r"""Chat formatting checked by a grammar round trip.

Template, one piece per turn::

    ### <Role>[~<level>]: <content></turn>\n

``Role`` is the percent-encoded role; the level mark is absent at level 0. A
deterministic parser reads the pieces back. Every rendered turn is reparsed at
once and compared with its source; while they differ (a control string in the
text, or a text that runs into the closing mark) the turn is rendered again
at the next escape level until the recovered turn is identical:

* level 0: the text as it is;
* level 1: one more backslash before each control string (``### `` or
  ``</turn>``) and its backslashes, so no bare control string is left;
* level 2: backslash and both first characters of control strings become
  ``\xHH``; no control string and no backslash before the closing mark can occur.
  Level 2 always reads back.

Conversations are streamed: rows are dealt by conversation, sorted inside the
partition, and formatted or parsed turn by turn with running digests, so a
conversation of any length needs the memory of one turn.

Edge cases: null text is empty; null role is the empty role; null ``conv_id`` is
one conversation of its own; rows with equal ``turn`` are ordered by role and
text (nulls first), repeated rows stay; an empty table gives an empty
result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import prepare

# The template's control strings
HEAD, END = "### ", "</turn>"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"(?<!\\)(\\*)(### |</turn>)")
_ESCAPED = re.compile(r"(?<!\\)\\(\\*)(### |</turn>)")
_HEADER = re.compile(r"### ([A-Za-z0-9_.%-]*)(?:~([12]))?: ")
_PART_OF_HEADER = re.compile(r"#{1,3}|### [A-Za-z0-9_.%-]*(?:~[12]?)?:?")
_HEX = re.compile(r"\\x([0-9a-f]{2})")
LEVELS = (0, 1, 2)


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return _CONTROL.sub(r"\\\1\2", text)
    return re.sub(r"[\\#<]", lambda m: f"\\x{ord(m[0]):02x}", text)


def unescape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return _ESCAPED.sub(r"\1\2", text)
    return _HEX.sub(lambda m: chr(int(m[1], 16)), text)


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The piece of one turn and the span of its content inside the piece."""
    mark = f"~{level}" if level else ""
    head = f"{HEAD}{quote(role, safe='').replace('~', '%7E')}{mark}: "
    body = escape(text, level)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(buffer: str, start: int = 0) -> tuple[str, str, int] | None:
    """The next turn of ``buffer`` from ``start``: (role, text, end), or None if
    the buffer ends before the turn does. Raises ValueError on bad grammar."""
    if len(buffer) == start:
        return None
    h = _HEADER.match(buffer, start)
    if not h:
        if _PART_OF_HEADER.fullmatch(buffer, start):
            return None
        raise ValueError("no turn header")
    at = h.end()
    while True:
        m = _CONTROL.search(buffer, at)
        if not m:
            return None
        if m[1]:  # an escaped control string is content
            at = m.end()
        elif m[2] == HEAD:
            raise ValueError("a bare turn header inside a turn")
        else:
            break
    if m.end() == len(buffer):
        return None
    if buffer[m.end()] != "\n":
        raise ValueError("no line end after a turn")
    return unquote(h[1]), unescape(buffer[h.end():m.start()], int(h[2] or 0)), m.end() + 1


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """(piece, content start, content end, level) at the lowest level whose
    piece reads back identical."""
    for level in LEVELS:
        piece, a, b = render(role, text, level)
        try:
            back = parse_turn(piece)
        except ValueError:
            continue
        if back == (role, text, len(piece)):
            return piece, a, b, level
    raise AssertionError("level 2 always reads back")


FORMATTED = ("conv_id long, seq long, formatted string, level int, "
             "loss_start long, loss_end long")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()),
                        ("level", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    conv, seq, offset, first = None, 0, 0, True
    for batch in batches:
        rows = []
        for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            if first or c != conv:
                conv, seq, offset, first = c, 0, 0, False
            role = r or ""
            piece, a, b, level = format_turn(role, t or "")
            loss = role == LOSS_ROLE
            rows.append((c, seq, piece, level, offset + a if loss else None, offset + b if loss else None))
            seq += 1
            offset += len(piece)
        yield pa.RecordBatch.from_arrays(
            [pa.array(col, f.type) for col, f in zip(zip(*rows), schema)] if rows
            else [pa.array([], f.type) for f in schema], schema=schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted pieces of (conv_id, turn, role, text): a conversation's text is
    its ``formatted`` pieces joined in order of ``seq``; the loss mask covers the
    code points from ``loss_start`` to ``loss_end`` of that text (null: none)."""
    prepare(turns.sparkSession)
    rows = (turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return rows.mapInArrow(_format, FORMATTED)


PARSED = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
          "loss_sha256 string, formatted_chars long")


class _Reader:
    """Reads one conversation back from its pieces, in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.masked, self.buffer = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, piece: str, start, end) -> None:
        if start is not None:
            body = piece[start - self.chars:end - self.chars]
            level = int(_HEADER.match(piece)[2] or 0)
            text = unescape(body, level)
            self.loss += len(text)
            self.masked.update(text.encode())
        self.chars += len(piece)
        self.buffer += piece
        at = 0
        while (turn := parse_turn(self.buffer, at)) is not None:
            self.all.update(f"{turn[0]}\n{turn[1]}\n".encode())
            self.turns += 1
            at = turn[2]
        self.buffer = self.buffer[at:]

    def done(self) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv} ends inside a turn")
        return (self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                        ("formatted_chars", pa.int64())])

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

    reader = None
    for batch in batches:
        rows = []
        cols = (batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end"))
        for c, piece, a, b in zip(*cols):
            if reader is None or c != reader.conv:
                if reader is not None:
                    rows.append(reader.done())
                reader = _Reader(c)
            reader.feed(piece, a, b)
        if rows:
            yield out(rows)
    if reader is not None:
        yield out([reader.done()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest what they say, one row each."""
    prepare(formatted.sparkSession)
    rows = (formatted.select("conv_id", "seq", "formatted", "loss_start", "loss_end")
            .repartition("conv_id").sortWithinPartitions("conv_id", "seq"))
    return rows.mapInArrow(_read, PARSED)
