"""Chat formatting from an event log.

The log is partitioned by conversation and sorted by turn and sequence.  Streamed
deltas, edits and regenerations fold into one message at a time, which is rendered
at once, so a task holds one message however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The control strings of the template, opening and closing, by role.
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
# any other role is written out between these before its text
ROLE_OPEN, ROLE_CLOSE, OTHER_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"
TRAINED = "assistant"

# every control string starts with one of these characters
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(
    r"\\.|" + "|".join(re.escape(m) for m in [*sum(MARKS.values(), ()), ROLE_OPEN, ROLE_CLOSE, OTHER_CLOSE]),
    re.DOTALL,
)
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    """No control string survives in the result; ``unescape`` restores the text."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turn and its loss spans, in code points of the turn."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = f"{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}", OTHER_CLOSE
    body = escape(text)
    spans = [(len(opening), len(opening) + len(body))] if role == TRAINED else []
    return opening + body + closing, spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted turns."""
    opened = {o: role for role, (o, _) in MARKS.items()}
    closings = {c for _, c in MARKS.values()} | {OTHER_CLOSE}
    turns, role, start = [], None, 0
    for token in _TOKEN.finditer(formatted):
        mark = token.group()
        if mark in opened:
            role, start = opened[mark], token.end()
        elif mark == ROLE_OPEN:
            start = token.end()
        elif mark == ROLE_CLOSE:
            role, start = unescape(formatted[start : token.start()]), token.end()
        elif mark in closings:
            turns.append((role, unescape(formatted[start : token.start()])))
    return turns


def fold(events: Iterable[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """Final (role, text) messages of one turn from its (kind, role, text) events in order.

    ``message`` starts a message, ``delta`` adds to it, ``edit`` replaces its text,
    ``regenerate`` discards its text and starts again from the event's own,
    ``delete`` removes it.  Other events before any message start one; an unknown
    kind is an error.
    """
    role, parts = None, None
    for kind, by, text in events:
        if kind not in KINDS:
            raise ValueError(f"unknown event kind {kind!r}")
        if kind == "delete":
            parts = None
        elif kind == "message" or parts is None:
            if parts is not None:
                yield role, "".join(parts)
            role, parts = by, [text]
        elif kind == "delta":
            parts.append(text)
        else:
            parts = [text]
    if parts is not None:
        yield role, "".join(parts)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _grouped(rows: Iterable[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Like itertools.groupby on the first ``width`` fields."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[:width])


def message_events(conversations: DataFrame) -> DataFrame:
    """Finished messages ``conv_id, turn, role, text`` as events."""
    return conversations.select(
        "conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )


def render_conversations(events: DataFrame, batch_rows: int = 256) -> DataFrame:
    """Formatted turns of every conversation, in order.

    Takes ``conv_id, turn, seq, kind, role, text`` and returns ``conv_id, part,
    formatted, loss``: the formatted conversation is its parts joined, ``loss``
    holds the spans of a part (code points) that training predicts, which is the
    text of each assistant turn.  Parts of a conversation lie together and in
    order within one partition.

    Events of a turn are ordered by ``seq``, kind, role and text, so that ties
    and repeated rows have one result; each ``message`` of a turn is a message.
    Missing text or role is empty, a missing id is a conversation, a missing turn
    comes first, a missing kind is ``message``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part, current = 0, object()
        for (conv, _), rows in _grouped(_rows(batches), 2):
            if conv != current:
                part, current = 0, conv
            for role, text in fold((kind, role, text) for _, _, kind, role, text in rows):
                formatted, spans = render_turn(role, text)
                out.append((conv, part, formatted, [{"start": a, "end": b} for a, b in spans]))
                part += 1
                if len(out) >= batch_rows:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("part", pa.int64()),
            ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
        )

    def text(name: str, default: str = ""):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)).alias(name)

    ordered = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "seq", text("kind", "message"), text("role"), text("text")
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions(*ordered.columns)
    return ordered.drop("seq").mapInArrow(
        run, "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>"
    )


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of formatted conversations, computed from the formatted parts alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``;
    the input's parts lie together and in order, as ``render_conversations``
    leaves them.
    """

    @dataclass
    class Digest:
        turns: int = 0
        loss_chars: int = 0
        chars: int = 0
        whole: object = field(default_factory=hashlib.sha256)
        loss: object = field(default_factory=hashlib.sha256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _grouped(_rows(batches), 1):
            d = Digest()
            for _, formatted, spans in rows:
                d.chars += len(formatted)
                for role, text in parse_turns(formatted):
                    d.turns += 1
                    d.whole.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    d.loss_chars += len(text)
                    d.loss.update(text.encode())
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([conv], pa.int64()),
                    "n_turns": pa.array([d.turns], pa.int64()),
                    "turns_sha256": [d.whole.hexdigest()],
                    "loss_chars": pa.array([d.loss_chars], pa.int64()),
                    "loss_sha256": [d.loss.hexdigest()],
                    "formatted_chars": pa.array([d.chars], pa.int64()),
                }
            )

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long"
    )
    return parts.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
