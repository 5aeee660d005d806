"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function from a list of (role, text) turns to one string. Successive prefixes
of a conversation are rendered; what a turn adds to the output is its span, and a second
rendering with a probe in place of the turn's text finds the text inside the span. An output
that doesn't begin with the output before it shows that the template rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

# Marks of the default template (fixed values).
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>")}
START, OTHER = "<s>", ("[ROLE {}] ", " [/ROLE]")
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\d"}  # the backslash goes first

KEPT_TURNS, KEPT_CHARS = 4_096, 2_000  # the default template keeps so many rendered turns for the next prefix, of texts up to this length
BATCH_CHARS = 1_000_000  # an Arrow batch is handed on once it holds so much formatted text

_PLAIN = {v: k for k, v in ESCAPES.items()}
_TURN = re.compile(
    r"\[SYS\] (?P<system>[^\[<]*) \[/SYS\]|\[INST\] (?P<user>[^\[<]*) \[/INST\]|\[ANS\] (?P<assistant>[^\[<]*) </s>"
    r"|\[ROLE (?P<role>[^\[\]<]*)\] (?P<other>[^\[<]*) \[/ROLE\]"
)


def escape(text: str) -> str:
    """Text in which no mark can occur, as it holds no angle or square bracket."""
    for plain, code in ESCAPES.items():  # str.translate is many times slower on text that isn't ASCII
        text = text.replace(plain, code)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text, flags=re.S)


def _marked_turn(role: str, text: str) -> str:
    head, tail = MARKS[role] if role in MARKS else (OTHER[0].format(escape(role)), OTHER[1])
    return head + escape(text) + tail


_kept_turn = lru_cache(KEPT_TURNS)(_marked_turn)


def marked(turns: Turns) -> str:
    """The default template: marks around every turn, control strings inside texts escaped."""
    return START + "".join([_kept_turn(role, text) if len(text) <= KEPT_CHARS else _marked_turn(role, text) for role, text in turns])


def read_marked(formatted: str) -> Turns:
    """The turns of an output of :func:`marked`."""
    if not formatted.startswith(START):
        raise ValueError("no start")
    turns, at = [], len(START)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
        at = m.end()
    return turns


@dataclass
class Located:
    """An output with, per turn, its span and the span of its text (None where it isn't plain)."""

    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    contents: list[tuple[int, int] | None] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(template: Template, turns: Turns) -> Located:
    """Render every prefix of ``turns`` and find what each turn added.

    ``rewrites`` lists the turns after which earlier output had changed. Their spans start where
    the outputs begin to differ, and spans of earlier turns no longer hold in the final text.
    """
    found = Located(template([]))
    for k, (role, text) in enumerate(turns):
        before, found.text = found.text, template(turns[: k + 1])
        start = len(before)
        if not found.text.startswith(before):
            found.rewrites.append(k)
            start = _common(before, found.text)
        found.spans.append((start, len(found.text)))
        probe = "probe"
        while probe in role or probe in text:
            probe += ""
        other = template([*turns[:k], (role, probe)])
        at = other.find(probe, start)
        tail = len(other) - at - len(probe)
        plain = at >= 0 and other.find(probe, at + 1) < 0 and len(found.text) - tail >= at
        plain = plain and other[start:at] == found.text[start:at] and found.text.endswith(other[len(other) - tail :])
        found.contents.append((at, len(found.text) - tail) if plain else None)
    return found


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Consecutive rows with one key, across batches."""
    return groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row[key])


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with ``formatted`` in Arrow batches; one batch a row would cost more than the row."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row["formatted"])
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_chats(
    conversations: DataFrame, template: Template = marked, key: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", section: int | None = None,
) -> DataFrame:
    """One row per conversation: ``key``, ``formatted``, ``spans``, ``rewrites``.

    ``spans`` has per turn its role, its span, the span of its text (null if the template changed
    it in place) and ``loss``, true for assistant turns with a known text span in a template that
    kept its history. Spans count code points. Turns are ordered by turn, then role, then text
    (nulls first; a null role or text is empty; repeated rows are turns of their own; rows with a
    null key form one conversation). Other columns are ignored; an empty table gives no rows. A
    conversation of any length is rendered whole, by every prefix, in one task, so it costs the
    square of its turns. ``section`` is accepted from older callers and has no effect.
    """
    rows = conversations.select(
        F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    kind = rows.schema["_key"].dataType
    spot = T.StructType(
        [T.StructField("role", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("start", "end", "text_start", "text_end")]
        + [T.StructField("loss", T.BooleanType())]
    )
    schema = T.StructType(
        [
            T.StructField(key, kind), T.StructField("formatted", T.StringType()),
            T.StructField("spans", T.ArrayType(spot)), T.StructField("rewrites", T.ArrayType(T.LongType())),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for value, group in _whole_groups(batches, "_key"):
            held: Turns = [(row["_role"], row["_text"]) for row in group]
            found = locate(template, held)
            spans = []
            for (who, _), (a, b), inner in zip(held, found.spans, found.contents, strict=True):
                c, d = inner if inner else (None, None)
                spans.append({"role": who, "start": a, "end": b, "text_start": c, "text_end": d, "loss": who == "assistant" and inner is not None and not found.rewrites})
            yield {key: value, "formatted": found.text, "spans": spans, "rewrites": found.rewrites}

    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_turn", "_role", "_text")
    return ordered.mapInArrow(lambda batches: _batches(rendered(batches), arrow), schema)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from outputs of :func:`marked`, one row per row of :func:`format_chats`.

    ``n_turns``, ``turns_sha256`` (role, line break, text, line break per turn), ``loss_chars`` and
    ``loss_sha256`` (texts under the loss mask, unescaped), ``formatted_chars``, ``n_rewrites``.
    """
    kind = formatted.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()), T.StructField("n_rewrites", T.LongType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def digest(row: dict) -> dict:
        text, turns = row["formatted"], read_marked(row["formatted"])
        whole = "".join(f"{who}\n{said}\n" for who, said in turns)
        loss = "".join(unescape(text[span["text_start"] : span["text_end"]]) for span in row["_loss"])
        out = [
            row[key], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            len(text), row["_rewrites"],
        ]
        return dict(zip(schema.names, out, strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([digest(row) for row in batch.to_pylist()], schema=arrow)

    loss = F.transform(F.filter("spans", lambda span: span["loss"]), lambda span: F.struct(span["text_start"], span["text_end"]))
    return formatted.select(key, "formatted", loss.alias("_loss"), F.size("rewrites").alias("_rewrites")).mapInArrow(read, schema)
