"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn, whose texts carry loss, and which role may follow which.

    ``order`` maps a state to the roles allowed there and the state each leads
    to; ``ends`` are the states in which a conversation is complete.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role: ", " </role> ")
    close: str = " </turn>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: frozenset[str] = frozenset({"answered"})

    def controls(self) -> list[str]:
        return [c.strip() for c in (*self.opens.values(), *self.other, self.close)]


class Codec:
    """Writes turns by a template and reads them back.

    Inside a text every backslash is doubled and every control string gets a
    backslash after its first character, so no control string is left in it;
    reading back drops the first backslash of each pair.
    """

    def __init__(self, template: Template) -> None:
        self.t = template
        self._control = re.compile("|".join([r"\\", *map(re.escape, sorted(template.controls(), key=len, reverse=True))]))
        self._escaped = re.compile(r"\\(.)", re.DOTALL)
        self._roles = {header: role for role, header in template.opens.items()}

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text) if "\\" in text else text

    def write(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn with their loss flags."""
        t = self.t
        header = t.opens.get(role) or t.other[0] + self.escape(role) + t.other[1]
        if role in t.trained:
            return [(header, False), (self.escape(text), True), (t.close, False)]
        return [(header + self.escape(text) + t.close, False)]

    def read(self, turn: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        t = self.t
        if not turn.endswith(t.close):
            raise ValueError("a turn doesn't end with the closing marker")
        body = turn[: -len(t.close)]
        for header, role in self._roles.items():
            if body.startswith(header):
                return role, self.unescape(body[len(header) :])
        if not body.startswith(t.other[0]):
            raise ValueError("a turn doesn't begin with an opening marker")
        role, _, text = body[len(t.other[0]) :].partition(t.other[1])
        return self.unescape(role), self.unescape(text)


SEGMENTS = "conv_id long, segment long, turn long, text string, loss boolean, in_order boolean"


def format_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per segment, in order: conv_id, segment, turn (from 0), text, loss, in_order.

    A conversation's formatted text is its segments' texts end to end.  Turns
    follow by ``turn``, ties by role and text; null texts and roles count as
    empty, a null conv_id as one conversation.  in_order is whether the state
    machine allowed the roles up to this turn; turns that it did not allow are
    formatted all the same.  Roles without a marker of their own get the general
    one.  Repeated rows are turns of their own; other columns are not read; an
    empty table gives no rows.  Rows stream through their partition, so that a conversation of any
    length needs the memory of one turn.
    """
    t = template or Template()
    small_batches(chats.sparkSession, 1024)
    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, n_segment, n_turn, state = Codec(t), object(), 0, 0, "start"
        for b in batches:
            out = []
            ids, _, roles, said = (c.to_pylist() for c in b.columns)
            for conv, role, text in zip(ids, roles, said):
                if conv != now:
                    now, n_segment, n_turn, state = conv, 0, 0, "start"
                state = t.order.get(state, {}).get(role, "refused")
                for piece, loss in codec.write(role, text):
                    out.append((conv, n_segment, n_turn, piece, loss, state != "refused"))
                    n_segment += 1
                n_turn += 1
            kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.bool_()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "segment", "turn", "text", "loss", "in_order"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, parsed from its segments as ``format_chats`` deals and sorts them."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, turn = Codec(t), None, []
        done: list[tuple] = []

        class Conversation:
            def __init__(self, conv_id: int | None) -> None:
                self.id, self.n, self.chars, self.loss_chars, self.ok = conv_id, 0, 0, 0, True
                self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

            def row(self) -> tuple:
                return (self.id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok)

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

        for b in batches:
            ids, numbers, _, pieces, losses, oks = (c.to_pylist() for c in b.columns)
            for conv, number, piece, loss, ok in zip(ids, numbers, pieces, losses, oks):
                if number == 0:
                    if now:
                        done.append(now.row())
                    now, turn = Conversation(conv), []
                now.chars += len(piece)
                now.ok = now.ok and ok
                turn.append(piece)
                if loss:
                    plain = codec.unescape(piece)
                    now.loss_chars += len(plain)
                    now.loss.update(plain.encode())
                elif piece.endswith(t.close):
                    role, text = codec.read("".join(turn))
                    now.turns.update(f"{role}\n{text}\n".encode())
                    now.n += 1
                    turn = []
            if len(done) >= 1024:
                yield batch()
                done.clear()
        if now:
            done.append(now.row())
        if done:
            yield batch()

    return segments.mapInArrow(run, DIGESTS)
