"""Chat formatting with a grammar round trip.

Template (fixed values): a user turn is `[INST] text [/INST]`, a system turn
`<<SYS>> text <</SYS>>`, an assistant turn `<s> text </s>`, any other role
`<<ROLE>>role<</ROLE>> text </s>`.  The grammar is a prefix code: the opening
string decides the turn, the next unescaped closing string ends it, and a backslash
makes the next character plain.  So turns are parsed one after another, whatever a
text says.

A turn is first rendered as it is.  When the parser does not give back exactly this
turn and nothing more, its backslashes and the first characters of control strings
are escaped, and the result must then agree.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Opening and closing strings by role.
TURNS = {
    "user": ("[INST] ", " [/INST]"),
    "system": ("<<SYS>> ", " <</SYS>>"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("<<ROLE>>", "<</ROLE>> ", " </s>")
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>")
LOSS_ROLE = "assistant"

_RISKY = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED = re.compile(r"(?s)\\(.)")


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _until(s: str, at: int, close: str) -> tuple[str, int] | None:
    """The raw text from `at` to the next unescaped `close`, and the place after it."""
    look = at
    while True:
        end = s.find(close, look)
        if end < 0:
            return None
        slashes = 0
        # the closing string starts with a blank or bracket: escaped by an odd run before it
        while end - slashes > at and s[end - slashes - 1] == "\\":
            slashes += 1
        if slashes % 2 == 0:
            return s[at:end], end + len(close)
        look = end + 1


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """role, text, text start, text end, next place; None when no turn starts at `at`."""
    for role, (start, close) in TURNS.items():
        if s.startswith(start, at):
            found = _until(s, at + len(start), close)
            if not found:
                return None
            begin = at + len(start)
            return role, unescape(found[0]), begin, begin + len(found[0]), found[1]
    if s.startswith(OTHER[0], at):
        name = _until(s, at + len(OTHER[0]), OTHER[1])
        found = name and _until(s, name[1], OTHER[2])
        if found:
            return unescape(name[0]), unescape(found[0]), name[1], name[1] + len(found[0]), found[1]
    return None


def parse(s: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation; raises ValueError where the grammar fails."""
    turns, at = [], 0
    while at < len(s):
        turn = parse_turn(s, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        turns.append(turn[:2])
        at = turn[4]
    return turns


def _raw(role: str, text: str, name: str) -> str:
    if role in TURNS:
        return TURNS[role][0] + text + TURNS[role][1]
    return OTHER[0] + name + OTHER[1] + text + OTHER[2]


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int, bool]:
    """Rendered turn, where its text starts and ends, whether it had to be escaped."""
    role, text = role or "", text or ""
    for escaped in (False, True):
        f = escape if escaped else str
        out = _raw(role, f(text), f(role))
        turn = parse_turn(out)
        # control strings in a text are escaped even where the parser would recover them
        if turn and turn[:2] == (role, text) and turn[4] == len(out) \
                and (escaped or not _RISKY.search(text + role)):
            return out, turn[2], turn[3], escaped
    raise ValueError(f"a turn of role {role!r} does not survive the round trip")


def render(turns) -> str:
    return "".join(render_turn(role, text)[0] for role, text in turns)


def _render_batches(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [render_turn(r, t) for r, t in zip(b.column("role").to_pylist(),
                                                  b.column("text").to_pylist())]
        mask = [r == LOSS_ROLE for r in b.column("role").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("turn"), b.column("role"),
             pa.array([d[0] for d in done], pa.string()),
             pa.array([d[1] if m else None for d, m in zip(done, mask)], pa.int64()),
             pa.array([d[2] if m else None for d, m in zip(done, mask)], pa.int64()),
             pa.array([d[3] for d in done], pa.bool_())],
            ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "escaped"])


RENDERED = ("conv_id bigint, turn bigint, role string, formatted string, loss_start bigint, "
            "loss_end bigint, escaped boolean")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: the rendered piece and the loss span in it (assistant texts).

    A conversation's text is its pieces in order of (turn, role, piece).  Null texts and
    roles count as empty; a null turn comes first; rows repeated in all columns are
    repeated turns.  Other columns are ignored.
    """
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (
        ("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))])
    return rows.mapInArrow(_render_batches, RENDERED)


class _Reader:
    """Reads one conversation back, piece by piece, in constant memory."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, piece, start, end):
        at = 0
        while at < len(piece):
            turn = parse_turn(piece, at)
            if turn is None:
                raise ValueError(f"conversation {self.conv_id}: no turn at {self.chars + at}")
            self.turns += 1
            self.all.update(f"{turn[0]}\n{turn[1]}\n".encode("utf-8", "surrogatepass"))
            at = turn[4]
        if start is not None:
            text = unescape(piece[start:end])
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)

    def row(self):
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss,
                self.masked.hexdigest(), self.chars)


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
          "loss_sha256 string, formatted_chars bigint")


def _read_batches(batches) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    reader, done = None, []
    for b in batches:
        for conv, piece, start, end in zip(*[b.column(c).to_pylist() for c in (
                "conv_id", "formatted", "loss_start", "loss_end")]):
            if reader is None or reader.conv_id != conv:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv)
            reader.add(piece, start, end)
        if len(done) >= 1000:
            yield out(done)
            done = []
    if reader:
        done.append(reader.row())
    if done:
        yield out(done)


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, parsed from the rendered pieces: turns, digests, loss text, length.

    Pieces are dealt by conversation and sorted on disk where needed; a task streams
    them, so a conversation of any length needs no more memory than its longest turn.
    """
    rows = (rendered.repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "formatted")
            .select("conv_id", "formatted", "loss_start", "loss_end"))
    return rows.mapInArrow(_read_batches, DIGEST)
