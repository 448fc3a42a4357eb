"""Chat formatting from an event log.

Conversations arrive as events (conv, seq, tie, part, kind, turn, role, text), in order of seq, tie and
part. The log is partitioned by conversation
and sorted by sequence; a fold turns streamed deltas, edits and regenerations into final messages; each
message is rendered as one segment of the conversation's training text, with the part under the loss mask.
The fold holds one conversation's open messages; a message is rendered and let go once a later turn is
under way and a ``close`` event says that no edit can reach it, or else at the conversation's end.

Control strings inside texts are escaped with one sign that is itself escaped, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shipping import ship

#: The template's own marks and the control strings of other well-known templates.
OPEN, SPLIT, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROLS = [OPEN, SPLIT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
SIGN = "␛"
_CODE = {s: SIGN + chr(ord("a") + i) for i, s in enumerate([SIGN, *CONTROLS])}
_PLAIN = {v: k for k, v in _CODE.items()}
_ESCAPE = re.compile("|".join(map(re.escape, sorted(_CODE, key=len, reverse=True))))
_UNESCAPE = re.compile(f"{SIGN}(.)", re.S)
_SEGMENT = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(SPLIT)}(.*?){re.escape(END)}\n", re.S)

EVENTS = "conv long, seq long, tie string, part long, kind string, turn long, role string, text string"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[0]], text)


@dataclass
class Message:
    turn: int
    role: str
    parts: list[str]


def fold(events: Iterable[tuple]) -> Iterator[tuple[int, Message]]:
    """Final messages (conv, message) of events (see EVENTS) in order.

    kinds: ``message`` opens a turn with its text; ``delta`` adds text to the turn, opening it if needed;
    ``edit`` replaces the turn's text; ``regenerate`` empties it for new deltas and drops every later turn;
    ``delete`` removes it; ``close`` says that turns up to this one are final. Null texts and roles are
    empty. An event of a turn that doesn't exist opens it, but for ``delete`` and ``close``; an unknown
    kind raises. Turns come out in the order in which they were opened.
    """
    conv, open_, begun = None, {}, False
    for c, _, _, _, kind, turn, role, text in events:
        if c != conv or not begun:
            yield from ((conv, m) for m in open_.values())
            conv, open_, begun = c, {}, True
        text = text or ""
        m = open_.get(turn)
        if kind == "close":
            for t in [t for t in open_ if t <= turn]:
                yield conv, open_.pop(t)
        elif kind == "delete":
            open_.pop(turn, None)
        elif kind in ("message", "delta", "edit", "regenerate"):
            if m is None:
                open_[turn] = Message(turn, role or "", [text])
            elif kind == "delta":
                m.parts.append(text)
            else:
                m.parts, m.role = [text], role if role is not None else m.role
                if kind == "regenerate":
                    later = False
                    for t in list(open_):
                        if later:
                            del open_[t]
                        later |= t == turn
        else:
            raise ValueError(f"unknown event kind {kind!r}")
    yield from ((conv, m) for m in open_.values())


def render(role: str, text: str, trained: Iterable[str] = ("assistant",)) -> tuple[str, int, int]:
    """(segment, start, end): the mask covers the escaped text of a trained role, else nothing."""
    head = f"{OPEN}{escape(role)}{SPLIT}"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role in trained else (0, 0)
    return f"{head}{body}{END}\n", *span


def read_back(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered segment."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError("not a segment")
    return unescape(m[1]), unescape(m[2])


def format_conversations(events: DataFrame, trained: Iterable[str] = ("assistant",)) -> DataFrame:
    """Segments (conv, n, turn, segment, loss_start, loss_end) of the conversations' training texts.

    The conversation's text is its segments in order of n; offsets are code points from the conversation's
    start. One row per message, so a conversation of any length stays in bounded rows; the fold streams
    over the sorted log. events need the columns of EVENTS, others are not read; equal places in the log
    are taken by kind, turn, role and text. Null conversation ids are one conversation, null turns one turn
    before all others.
    """
    trained = tuple(trained)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out, size, conv, n, at = [], 0, (), 0, 0
        for c, m in fold(rows()):
            if (c,) != conv:
                conv, n, at = (c,), 0, 0
            segment, start, end = render(m.role, "".join(m.parts), trained)
            masked = m.role in trained
            out.append((c, n, m.turn, segment, at + start if masked else None, at + end if masked else None))
            n, at, size = n + 1, at + len(segment), size + len(segment)
            if len(out) >= 5000 or size > 1 << 23:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    ship(events.sparkSession)
    return _sorted(events).mapInArrow(run, "conv long, n long, turn long, segment string, loss_start long, loss_end long")


def _sorted(events: DataFrame) -> DataFrame:
    fields = [f.split() for f in EVENTS.split(", ")]
    e = events.select(*(F.col(c).cast(t).alias(c) for c, t in fields)).withColumn("turn", F.coalesce("turn", F.lit(-(1 << 63))))
    return e.repartition("conv").sortWithinPartitions(*(c for c, _ in fields))


_OUT = pa.schema([("conv", pa.int64()), ("n", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Takes the output of ``format_conversations`` as it comes, partitioned and in order."""

    def run(batches):
        out, conv, state = [], (), None

        def done():
            c, n, turns, chars, loss, total = state
            out.append((c, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            for c, segment, start, end in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (c,) != conv:
                    if state:
                        done()
                    conv, state = (c,), [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    under = unescape(segment[start - state[5] : end - state[5]])
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(segment)
            if len(out) > 5000:
                yield _digest_batch(out)
                out.clear()
        if state:
            done()
        if out:
            yield _digest_batch(out)

    ship(segments.sparkSession)
    return segments.select("conv", "segment", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def as_events(conversations: DataFrame, piece: int = 4096) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as the log that streaming them would leave: each row opens its
    turn with its first ``piece`` code points, streams the rest as deltas and closes. Rows that share a turn
    number are turns of their own, in order of role and a hash of the text; rows that repeat stay apart, and
    as they are equal it doesn't matter which comes first. Null texts and roles are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    last = F.greatest(F.lit(0), F.ceil(F.length("text") / piece) - 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("part"), F.when(i == 0, "message").otherwise("delta").alias("kind"), F.substring(F.col("text"), i * piece + 1, F.lit(piece)).alias("text")))
    close = F.array(F.struct((last + 1).alias("part"), F.lit("close").alias("kind"), F.lit(None).cast("string").alias("text")))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    tie = F.format_string("%s\n%016x\n%020d", "role", F.xxhash64("text"), "row")
    log = rows.select("conv", F.col("turn").alias("seq"), tie.alias("tie"), "turn", "role", F.explode(F.concat(parts, close)).alias("e"))
    return log.select("conv", "seq", "tie", F.col("e.part").alias("part"), F.col("e.kind").alias("kind"), "turn", "role", F.col("e.text").alias("text"))
