"""Chat formatting with a grammar that is read back.

Every turn is rendered on its own as ``opening text closing``; a conversation's
output is its turns' renderings in order.  A rendering is parsed again at once,
and if the turn does not come back identical, control strings in its texts get
a backslash in front (one more than they have), until it does.  The parser
takes a control string with a backslash before it as text and removes one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>> ", "user": "<s>[INST] ", "assistant": "[ASST] "}
CLOSE = {"system": " <</SYS>>", "user": " [/INST]", "assistant": " </s>"}
ROLE, END_ROLE, END_OTHER = "[ROLE] ", " [/ROLE] ", " [/TURN]"
CONTROLS = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ASST]", "[ROLE]", "[/ROLE]", "[/TURN]")
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], text)


class Parser:
    """Reads renderings piece by piece: ``feed`` gives the turns that ended, ``close`` checks the rest.

    Grammar: turn = opening, text, closing, where an unknown role is written
    out before its text.  Only the turn that is being read is held.
    """

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str):
        self.rest = self.rest + piece if self.rest else piece
        at, done = 0, []
        while True:
            got = self._turn(at)
            if got is None:
                break
            role, text, at = got
            done.append((role, text))
        self.rest = self.rest[at:]
        return done

    def close(self):
        if self.rest:
            raise ValueError(f"not a turn: {self.rest[:80]!r}")

    def _bare(self, at: int):
        """The next control string that has no backslash before it."""
        for m in _CONTROL.finditer(self.rest, at):
            if not m[1]:
                return m
        return None

    def _text(self, at: int, closing: str):
        """Text up to ``closing``, which must be the next bare control string; and where reading goes on."""
        end = self._bare(at)
        if end is None:
            return None
        a = end.start() - 1
        if end[2] != closing.strip() or self.rest[a: a + len(closing)] != closing or a < at:
            raise ValueError(f"{end[2]} inside a text")
        return unescape(self.rest[at:a]), a + len(closing)

    def _turn(self, at: int):
        if at >= len(self.rest):
            return None
        for role, opening in OPEN.items():
            if self.rest.startswith(opening, at):
                got = self._text(at + len(opening), CLOSE[role])
                return None if got is None else (role, *got)
        if self.rest.startswith(ROLE, at):
            got = self._text(at + len(ROLE), END_ROLE)
            if got is None:
                return None
            role, at = got
            got = self._text(at, END_OTHER)
            return None if got is None else (role, *got)
        raise ValueError(f"not an opening: {self.rest[at: at + 40]!r}")


def _write(role: str, text: str) -> tuple[str, int, int]:
    if role in OPEN:
        head, tail = OPEN[role], CLOSE[role]
    else:
        head, tail = f"{ROLE}{role}{END_ROLE}", END_OTHER
    return head + text + tail, len(head), len(head) + len(text)


def _reads(piece: str, role: str, text: str) -> bool:
    parser = Parser()
    try:
        got = parser.feed(piece)
        parser.close()
    except ValueError:
        return False
    return got == [(role, text)]


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendering of one turn and where its (escaped) text stands in it.

    Texts go in as they are first; whatever does not read back is escaped.
    Null roles and texts count as empty.  A role that is not one of the named
    ones is written out.
    """
    role, text = role or "", text or ""
    piece = _write(role, text)
    if "[" in text or "<" in text or role not in OPEN:
        own, said = role, text
        for _ in range(2):
            if _reads(piece[0], role, text):
                break
            own, said = (role if role in OPEN else escape(role)), escape(text)
            piece = _write(own, said)
        else:
            if not _reads(piece[0], role, text):
                raise ValueError(f"no rendering of {text[:80]!r} reads back")
    return piece


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, piece, loss_start, loss_end): one row per turn, no shuffle.

    ``piece`` is the turn's part of its conversation's output.  The loss mask of
    an assistant turn are the code points from ``loss_start`` to ``loss_end`` of
    its piece; other turns have an empty one.  Nulls in ``conv_id`` and ``turn``
    stay; repeated rows are turns of their own; other columns are left out.
    """
    def render(batches):
        for batch in batches:
            roles = batch.column(2).to_pylist()
            made = [render_turn(r, t) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
            mask = [(a, b) if r == "assistant" else (0, 0) for r, (_, a, b) in zip(roles, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([m[0] for m in made], pa.string()),
                 pa.array([a for a, _ in mask], pa.int64()), pa.array([b for _, b in mask], pa.int64())],
                ["conv_id", "turn", "role", "piece", "loss_start", "loss_end"])

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(
        render, "conv_id long, turn long, role string, piece string, loss_start long, loss_end long")


class _Digest:
    def __init__(self):
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, piece, a, b):
        self.chars += len(piece)
        for role, text in self.parser.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if b > a:
            said = unescape(piece[a:b])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))

    def row(self, conv_id):
        self.parser.close()
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the output of ``format_turns``.

    Pieces go to tasks by conversation, sorted by turn (then role and text),
    and are read one after another: a conversation of any length is streamed
    through the parser and its hashes and never held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    def read(batches):
        key, state = None, None
        for batch in batches:
            done = []
            ids = batch.column(0).to_pylist()
            cols = [batch.column(k).to_pylist() for k in (1, 2, 3)]
            for conv, piece, a, b in zip(ids, *cols, strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(state.row(key))
                    key, state = conv, _Digest()
                state.add(piece, a, b)
            yield pack(done)
        if state is not None:
            yield pack([state.row(key)])

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return rows.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
