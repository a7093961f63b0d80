"""Chat formatting of typed content parts.

A message holds parts of type text, image, audio or document.  A visitor with one method per type flattens them in order:
text is escaped and written; each other part becomes a numbered placeholder, its reference is recorded as an attachment
with the number of tokens that a model expands it to, and unknown types are refused.

The template writes a turn as ``<|turn|>role<|text|>content<|end|>``.  Inside texts, roles and references ``<|`` is written
``<||`` and so is any run that could be read back as it: ``<`` and one or more bars gets one bar more.  Nothing inside a
text can therefore read as control, and removing one bar restores it.  The loss mask covers the content of assistant turns.

A conversation is never held whole: turns are sorted within partitions and formatted one at a time.  Each has its place in
its conversation, so stored turns can be read back from any files in any order: they are sorted by it, parsed one at a time,
and hashed as they pass.  A conversation of any length takes the memory of one turn.

Defined results: a null text is empty, a null role is written as an empty role; turns are ordered by turn (nulls first),
then role, then parts; rows with a null conv_id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import core

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PARSE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return re.sub(r"<(\|+)", r"<\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\|+)\|", r"<\1", text)


@dataclass
class Part:
    kind: str
    text: str = ""
    ref: str = ""
    width: int = 0
    height: int = 0
    seconds: float = 0.0
    pages: int = 0


@dataclass
class Flattened:
    """What the visitor makes of the parts of one message."""

    content: str = ""
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0


class Flattener:
    """Visits parts in order.  ``first``: the number of the message's first attachment."""

    def __init__(self, first: int = 0, patch: int = 14, tokens_per_second: int = 25, tokens_per_page: int = 512):
        self.next, self.patch, self.per_second, self.per_page = first, patch, tokens_per_second, tokens_per_page
        self.out, self.pending = Flattened(), ""

    def visit(self, part: Part) -> None:
        method = getattr(self, f"visit_{part.kind}", None)
        if method is None:
            raise ValueError(f"no content part of type {part.kind!r}")
        method(part)

    def visit_text(self, part: Part) -> None:
        self.pending += part.text or ""  # neighbouring texts are one text to the escape

    def finish(self) -> Flattened:
        self.out.content += escape(self.pending)
        self.pending = ""
        return self.out

    def visit_image(self, part: Part) -> None:
        """One token for each patch that the image covers."""
        self._attach(part, -(-part.width // self.patch) * -(-part.height // self.patch))

    def visit_audio(self, part: Part) -> None:
        self._attach(part, -int(-part.seconds * self.per_second // 1))

    def visit_document(self, part: Part) -> None:
        self._attach(part, part.pages * self.per_page)

    def _attach(self, part: Part, tokens: int) -> None:
        self.finish()
        self.out.content += f"<|{part.kind}:{self.next}|>"
        self.out.attachments.append({"number": self.next, "kind": part.kind, "ref": part.ref, "tokens": tokens})
        self.out.expanded_tokens += tokens
        self.next += 1


def flatten(parts: Iterable[Part], first: int = 0, **sizes: int) -> Flattened:
    visitor = Flattener(first, **sizes)
    for p in parts:
        visitor.visit(p)
    return visitor.finish()


def format_turn(role: str, content: str) -> tuple[str, tuple[int, int]]:
    """The formatted turn and the span of its content in it.  ``content`` comes from ``flatten``."""
    head = f"{TURN}{escape(role)}{TEXT}"
    return f"{head}{content}{END}", (len(head), len(head) + len(content))


def parse(formatted: str) -> list[tuple[str, list[Part]]]:
    """Turns as written: roles and parts, with the number of an attachment as its reference."""
    out, at = [], 0
    for m in _PARSE.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at, parts, done = m.end(), [], 0
        for p in _PLACE.finditer(m[2]):
            if p.start() > done:
                parts.append(Part("text", unescape(m[2][done : p.start()])))
            parts.append(Part(p[1], ref=p[2]))
            done = p.end()
        if done < len(m[2]) or not parts:
            parts.append(Part("text", unescape(m[2][done:])))
        out.append((unescape(m[1]), parts))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


PART = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURNS = "conv_id long, place long, turn long, role string, formatted string, loss array<struct<start:int,stop:int>>, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"


def format_messages(messages: DataFrame) -> DataFrame:
    """Formats (conv_id, turn, role, parts) turn by turn, in order within each conversation.

    Attachments are numbered through a conversation; the loss spans are those of the turn's own formatted text.
    """
    core.small_batches(messages.sparkSession)
    kind = F.coalesce(F.col("parts").cast(PART), F.array().cast(PART))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), kind.alias("parts"))
    rows = rows.repartition(core.tasks(messages.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    names = ["conv_id", "place", "turn", "role", "formatted", "loss", "attachments", "expanded_tokens"]
    span, ref = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span, ref, pa.int64()]

    def run(batches):
        now, place, number = object(), 0, 0
        for batch in batches:
            out = []
            for conv, turn, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    now, place, number = conv, 0, 0
                got = flatten((Part(**{k: v for k, v in p.items() if v is not None}) for p in parts if p is not None), number)
                number += len(got.attachments)
                formatted, (a, b) = format_turn(role, got.content)
                out.append((conv, place, turn, role, formatted, [{"start": a, "stop": b}] if role == "assistant" else [], got.attachments, got.expanded_tokens))
                place += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return rows.mapInArrow(run, TURNS)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of conversations, from formatted turns as ``format_messages`` makes them, stored in any order; attachments
    have no text."""
    core.small_batches(turns.sparkSession)
    rows = turns.select("conv_id", "place", "formatted", "loss").repartition(core.tasks(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches):
        now, state, done = object(), None, []

        def close():
            if state:
                n, all_text, chars, loss, size = state
                done.append((now, n, all_text.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, parts in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{''.join(p.text for p in parts)}\n".encode())
                for s in spans:
                    text = unescape(_PLACE.sub("", formatted[s["start"] : s["stop"]]))
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if done:
                yield _digests(done)
                done = []
        close()
        if done:
            yield _digests(done)

    return rows.mapInArrow(run, SCHEMA)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def text_messages(conversations: DataFrame) -> DataFrame:
    """Conversations of plain texts as messages of one text part each."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
