"""Chat formatting from a declarative template.

A finite-state machine over roles checks the order of turns. Each turn is emitted as
segments: control strings, the role and the text, each with a loss flag. Control
strings that occur in a role or a text are broken by the escape mark after their
first character, and the mark itself is doubled, so that reading back is exact: a
control string found in the output always is one that the template wrote.

A conversation is one sequence of states and digests: its turns are shuffled to one
task, sorted there with spilling, and streamed one after another. Memory holds one
Arrow batch, however many turns a conversation has.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like, which texts are learned, and which role may follow which."""

    turn_start: str = "<|im_start|>"
    role_end: str = "<|im_sep|>"
    turn_end: str = "<|im_end|>"
    loss_roles: frozenset = frozenset({"assistant"})
    start: str = "start"
    accept: frozenset = frozenset({"assistant"})
    # state -> roles that may follow; a role's name is the state it leads to
    follows: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    # control strings of other templates, which must not pass as such either
    reserved: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or MARK in c or any(c[0] in other[1:] for other in self.controls):
                raise ValueError(f"control string {c!r}: no control string may hold its first character again")

    @property
    def controls(self) -> tuple:
        return (self.turn_start, self.role_end, self.turn_end, *self.reserved)


CHAT = ChatTemplate()


class ChatCodec:
    def __init__(self, template: ChatTemplate = CHAT):
        self.t = template
        longest_first = sorted(template.controls, key=len, reverse=True)
        self._risky = re.compile("|".join(map(re.escape, [*longest_first, MARK])))
        self._marked = re.compile(re.escape(MARK) + "(.)", re.S)
        self._turn = re.compile(
            f"{re.escape(template.turn_start)}(.*?){re.escape(template.role_end)}(.*?){re.escape(template.turn_end)}", re.S
        )

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: MARK + MARK if m[0] == MARK else m[0][0] + MARK + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._marked.sub(r"\1", text)

    def step(self, state: str, role: str) -> str:
        """The state after ``role``; ``error`` is left only by a new conversation."""
        return role if role in self.t.follows.get(state, ()) else "error"

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        learned = role in self.t.loss_roles
        return [
            (self.t.turn_start, False), (self.escape(role), False), (self.t.role_end, False),
            (self.escape(text), learned), (self.t.turn_end, False),
        ]

    def read_turn(self, piece: str) -> tuple[str, str]:
        found = self._turn.fullmatch(piece)
        if not found:
            raise ValueError("not a formatted turn")
        return self.unescape(found[1]), self.unescape(found[2])


def format_conversations(turns: DataFrame, template: ChatTemplate = CHAT) -> DataFrame:
    """(conv_id, position, piece, loss_start, loss_length, state): one row per turn.

    A conversation's output is its pieces in order of ``position``; the span of
    ``piece`` under the loss mask has code point offsets and may be empty. ``state``
    is the machine's state after the turn, ``error`` from the first turn out of order.

    Turns are ordered by turn (null first), ties by role and text; repeated rows are
    turns of their own. Null roles and texts are empty; rows with a null conv_id make
    one conversation. Other columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        codec, now, state, position = ChatCodec(template), object(), "", 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    now, state, position = conv, template.start, 0
                state = codec.step(state, role)
                piece, loss = "", (0, 0)
                for segment, learned in codec.segments(role, text):
                    if learned:
                        loss = (len(piece), len(segment))
                    piece += segment
                out.append((conv, position, piece, *loss, state))
                position += 1
            names = ("conv_id", "position", "piece", "loss_start", "loss_length", "state")
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    return ordered.mapInArrow(run, f"conv_id {kind}, position long, piece string, loss_start long, loss_length long, state string")


def read_back(formatted: DataFrame, template: ChatTemplate = CHAT, in_order: bool = False) -> DataFrame:
    """Per conversation, read from its pieces alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars and valid (the turns' order was accepted).

    ``in_order``: each task has whole conversations, in order, as format_conversations
    leaves them; else they are shuffled and sorted first.
    """
    rows = formatted.select("conv_id", "position", "piece", "loss_start", "loss_length")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        codec = ChatCodec(template)
        now, open_, n, chars, learned, turns, loss, state = None, False, 0, 0, 0, None, None, ""
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")

        def close():
            return (now, n, turns.hexdigest(), learned, loss.hexdigest(), chars, state in template.accept)

        for batch in batches:
            out = []
            for conv, piece, at, length in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not open_ or conv != now:
                    if open_:
                        out.append(close())
                    now, open_, n, chars, learned, state = conv, True, 0, 0, 0, template.start
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text = codec.read_turn(piece)
                state = codec.step(state, role)
                turns.update(f"{role}\n{text}\n".encode())
                under = codec.unescape(piece[at : at + length])
                loss.update(under.encode())
                n, chars, learned = n + 1, chars + len(piece), learned + len(under)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if open_:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(close(), kinds)], names=names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return rows.mapInArrow(run, schema)
