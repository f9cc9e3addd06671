"""Chat formatting: a state machine over roles emits text segments with loss flags.

A :class:`Template` declares, by role, what stands before and after a text and
whether the text is learned from. :func:`format_conversations` walks each
conversation in turn order, checks the order against ``Template.after`` and
emits segments; :func:`read_back` parses the concatenated segments again.

Rows come sorted within partitions and stream through one Arrow batch at a
time, so a task holds one turn and never a conversation, however long.

Defined cases: a null text is empty; a null or unknown role is written with the
template's ``other`` header and counted as a violation; rows with equal turn
are ordered by role, then text, and repeated rows are turns of their own; a
null turn comes first; rows with a null ``conv_id`` form one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id bigint, seg bigint, part string, text string, loss boolean, violation boolean"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, violations bigint"


@dataclass(frozen=True)
class Template:
    """Markers of a turn, the roles' names in headers, and the allowed order."""

    mark: str = "### "
    close: str = "</turn>"
    after_close: str = "\n"
    colon: str = ": "
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "@"
    learned: tuple = ("assistant",)
    #: State to the roles that may follow it; "" is the start.
    after: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.mark.strip(), self.close)

    def escape(self, text: str) -> str:
        """Double every backslash, and put one behind the first character of every control string, so that none is left."""
        inside = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return re.sub(rf"(\\)|{inside}", lambda m: "\\\\" if m[1] else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def header(self, role: str | None) -> str:
        if role in self.names:
            return f"{self.mark}{self.names[role]}{self.colon}"
        return f"{self.mark}{self.other}{self.escape(role or '').replace(':', chr(92) + ':')}{self.colon}"

    def role_of(self, name: str) -> str:
        if name.startswith(self.other):
            return self.unescape(name[len(self.other) :])
        return {v: k for k, v in self.names.items()}[name]


def unescaped(text: str, what: str, start: int) -> int:
    """Where ``what`` next stands in ``text`` with an even number of backslashes before it, or -1."""
    while (at := text.find(what, start)) >= 0:
        back = at
        while back > start and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        start = at + 1 if (at - back) else at + len(what)
    return -1


def in_order(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, one after another."""
    turns = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation: ``conv_id, seg, part, text, loss, violation``.

    ``part`` is head, text or tail. The segments' texts in order of ``seg`` are
    the formatted conversation. ``violation`` marks the head of a turn whose
    role may not stand there; such turns are written all the same.
    """
    template = template or Template()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, seg = object(), "", 0
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, state, seg = conv, "", 0
                bad = role not in template.after.get(state, ())
                state = role if role in template.names else state
                rows.append((conv, seg, "head", template.header(role), False, bad))
                rows.append((conv, seg + 1, "text", template.escape(text), role in template.learned, False))
                rows.append((conv, seg + 2, "tail", template.close + template.after_close, False, False))
                seg += 3
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "seg", "part", "text", "loss", "violation"])

    return in_order(conversations).mapInArrow(emit, SEGMENTS)


class Reader:
    """Parses the formatted text of one conversation as it arrives."""

    def __init__(self, template: Template):
        self.template, self.buffer, self.turns, self.chars, self.bad = template, "", 0, 0, 0
        self.all, self.learned, self.learned_chars = hashlib.sha256(), hashlib.sha256(), 0

    def add(self, text: str, loss: bool, bad: bool) -> None:
        t = self.template
        self.chars += len(text)
        self.bad += bad
        self.buffer += text
        if loss:
            plain = t.unescape(text)
            self.learned.update(plain.encode("utf-8", "surrogatepass"))
            self.learned_chars += len(plain)
        end = t.close + t.after_close
        if not text.endswith(end):
            return
        while self.buffer.startswith(t.mark) and (colon := unescaped(self.buffer, t.colon, len(t.mark))) >= 0 and (close := unescaped(self.buffer, t.close, colon + len(t.colon))) >= 0:
            role = t.role_of(self.buffer[len(t.mark) : colon])
            body = t.unescape(self.buffer[colon + len(t.colon) : close])
            self.all.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
            self.buffer = self.buffer[close + len(end) :]

    def row(self, conv: int | None) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {conv}: text after the last turn")
        return conv, self.turns, self.all.hexdigest(), self.learned_chars, self.learned.hexdigest(), self.chars, self.bad


def read_back(segments: DataFrame, template: Template | None = None, in_place: bool = False) -> DataFrame:
    """One row a conversation, parsed from its formatted text and loss flags.

    ``in_place`` says that ``segments`` comes straight from
    :func:`format_conversations`, whose rows are in order already.
    """
    template = template or Template()
    parts = segments.select("conv_id", "seg", "text", "loss", "violation")
    if not in_place:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seg")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, names = None, None, [x.split()[0] for x in DIGEST.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            rows = []
            for conv, _, text, loss, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        rows.append(reader.row(current))
                    current, reader = conv, Reader(template)
                reader.add(text, loss, bad)
            if rows:
                yield pack(rows)
        if reader is not None:
            yield pack([reader.row(current)])

    return parts.mapInArrow(parse, DIGEST)
