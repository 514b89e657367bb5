"""Chat formatting by event sourcing: logs of deltas, edits and regenerations are folded into messages, then rendered with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treegrain.session import ship_code, spread

TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*)">\n(.*?)\n</turn>\n', re.DOTALL)
_CONTROL = re.compile(r"\\|<(?=/?turn\b)")
_ROLE = re.compile(r'[\\"]')
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
EVENT_KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    """Put a backslash before every backslash and before `<` of anything that looks like a mark, so no text can open or close a turn."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and the span of its escaped text in it."""
    head = '<turn role="' + _ROLE.sub(lambda m: "\\" + m[0], role) + '">\n'
    body = escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from rendered text. ValueError if anything stands between turns."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv, turn, role, text) of each final message from (conv, turn, seq, kind, role, text), sorted by conv, turn, seq.

    message (or null): a whole message, each a message of its own; delta: appends to the message that its turn streams;
    edit: replaces the turn's text; regenerate: drops the turn's text, to be streamed anew; delete: removes the turn.
    An edit, a regeneration or a deletion also drops what later turns had been given before it (a smaller seq).
    Only the current message is held, so a conversation may be of any length.
    """
    key, message, cutoff, conv = None, None, None, object()

    def end():
        if message is not None and message[1] is not None:
            yield (*key, message[0], "".join(message[1]))

    for c, turn, seq, kind, role, text in events:
        if c != conv:
            yield from end()
            conv, key, message, cutoff, pending = c, None, None, None, None
        if key is None or key[1] != turn:
            yield from end()
            if key is not None and pending is not None:
                cutoff = pending if cutoff is None else max(cutoff, pending)
            key, message, pending = (c, turn), None, None
        if cutoff is not None and seq is not None and seq < cutoff:
            continue
        if kind in (None, "message"):
            yield from end()
            message = [role or "", [text or ""]]
        elif kind == "delta":
            if message is None or message[1] is None:
                message = [role or (message or [""])[0], []]
            message[1].append(text or "")
        elif kind in ("edit", "regenerate", "delete"):
            pending = seq if pending is None or (seq is not None and seq > pending) else pending
            message = [role or (message or [""])[0], [text or ""] if kind == "edit" else None]
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    yield from end()


RENDERED = "conv_id long, turn long, position long, role string, formatted string, loss_start long, loss_end long"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def events():
        for b in batches:
            yield from zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("conv_id", "turn", "__seq", "__kind", "role", "text")))

    out, size, conv, position = [], 0, object(), 0

    def batch():
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RENDERED.split(", ")])

    for c, turn, role, text in fold(events()):
        position = position + 1 if c == conv else 0
        conv = c
        formatted, a, b = render(role, text)
        loss = role == "assistant"
        out.append((c, turn, position, role, formatted, a if loss else None, b if loss else None))
        size += len(formatted)
        if size > 1 << 20 or len(out) >= 5000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _arranged(logs: DataFrame) -> DataFrame:
    """conv_id, turn, __seq, __kind, role, text of any log: seq defaults to the turn, kind to message. Sorted within conversations."""
    has = set(logs.columns)
    rows = logs.select("conv_id", "turn", (F.col("seq") if "seq" in has else F.col("turn")).cast("long").alias("__seq"), (F.col("kind") if "kind" in has else F.lit(None)).cast("string").alias("__kind"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "__seq", "role", "text")


def format_conversations(logs: DataFrame) -> DataFrame:
    """Fold and render logs (conv_id, turn, role, text, and optionally seq and kind; others are ignored): one row per final message.

    The rows of a conversation, by position, joined without anything between them, are its formatted text; loss_start and loss_end span
    an assistant's escaped text within `formatted`. Null text and null role count as empty; null conv_id is one conversation, null turn
    comes first; messages with the same turn follow by seq, role and text; repeated rows are messages of their own; an empty
    table gives no rows. One shuffle, and a stream of messages after it: a conversation of any length is never held whole.
    """
    ship_code(logs.sparkSession)
    return _arranged(logs).mapInArrow(_render, RENDERED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, out = object(), None, []

    def close():
        turns, loss = state[1], state[3]
        out.append((conv, state[0], turns.hexdigest(), state[2], loss.hexdigest(), state[4]))

    def batch():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in READ_BACK.split(", ")])

    for b in batches:
        for c, formatted, a, z in zip(*(b.column(b.schema.names.index(k)).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if state is None or c != conv:
                if state is not None:
                    close()
                    if len(out) >= 5000:
                        yield batch()
                        out.clear()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                masked = unescape(formatted[a:z])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(formatted)
    if state is not None:
        close()
    if out:
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from format_conversations()'s rows as they stream out of it (same partitions, same order)."""
    return formatted.mapInArrow(_read_back, READ_BACK)
