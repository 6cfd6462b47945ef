"""Chat examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only the
reply is trainable. Turns that no reply follows become one last example without a target, so that
nothing of a conversation is lost.

A turn is written `<|im_start|>role`, a line break, its text, `<|im_end|>` and a line break. Inside
roles and texts each `<|`, and each `<` with backslashes before `|`, gets one more backslash; so
`<|` occurs in control strings only, and taking one backslash away restores the text. A line break
in a role is written `<|nl|>`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TARGET = "assistant"
#: Characters of examples in one batch, about; a longer example is a batch of its own.
BATCH_CHARS = 4_000_000

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and the span of its text there."""
    head = f"{START}{escape(role).replace(chr(10), BREAK)}\n"
    body = escape(text)
    return head + body + END, len(head), len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(text)))
    return turns


def _expand(batches):
    """Rows sorted by conversation and turn: the context grows in place, one example a reply."""
    names = ["conv_id", "example", "formatted", "loss_start", "loss_length"]
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()),
                        ("loss_start", pa.int64()), ("loss_length", pa.int64())])
    rows, size = [], 0
    current, started, context, example, open_turns = None, False, "", 0, False

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, type=schema.field(i).type) for i, c in enumerate(zip(*rows))], names=names)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not started or conv != current:
                if open_turns:
                    rows.append((current, example, context, None, None))
                    size += len(context)
                current, started, context, example, open_turns = conv, True, "", 0, False
            written, start, length = write_turn(role or "", text or "")
            at = len(context) + start
            context += written
            open_turns = role != TARGET
            if role == TARGET:
                rows.append((current, example, context, at, length))
                size += len(context)
                example += 1
            if size > BATCH_CHARS:
                yield flush()
                rows, size = [], 0
    if open_turns:
        rows.append((current, example, context, None, None))
    if rows:
        yield flush()


def prefix_targets(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Examples: `conv_id`, `example` (from 0), `formatted`, `loss_start`, `loss_length` (the span of
    the reply's escaped text, in code points; null in an example without a target).

    Turns go by `turn` (null first), ties by role and text, so repeated rows are turns of their
    own. Null roles and texts are empty; rows with a null conversation make up one conversation.
    Empty replies are targets of length 0. An empty table stays empty. A conversation is streamed
    through one task that holds one context and one batch; its examples come in order.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        _expand, "conv_id long, example long, formatted string, loss_start long, loss_length long"
    )


def _digest(batches):
    """Reads examples back, conversation after conversation; all but the last of a conversation
    give their reply, the last gives its turns too."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    held = None

    def summary(conv, formatted, loss, loss_chars, total):
        turns, digest = read_turns(formatted), hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        return conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), total

    for batch in batches:
        done = []
        for conv, example, formatted, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            if example == 0:
                if held is not None:
                    done.append(summary(*held))
                held = [conv, "", hashlib.sha256(), 0, 0]
            held[1] = formatted
            if start is not None:
                reply = unescape(formatted[start:start + length])
                held[2].update(reply.encode())
                held[3] += len(reply)
            held[4] += len(formatted)
        if done:
            yield _batch(names, done)
    if held is not None:
        yield _batch(names, [summary(*held)])


def _batch(names, rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: `conv_id`, `n_turns`, `turns_sha256`,
    `loss_chars`, `loss_sha256`, `formatted_chars` (code points of all its examples).

    `examples` as `prefix_targets` gives them: a conversation's examples follow one another in one
    partition, so nothing is shuffled. Examples read from elsewhere need `ordered` first.
    """
    return examples.select("conv_id", "example", "formatted", "loss_start", "loss_length").mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def ordered(examples: DataFrame) -> DataFrame:
    """Brings stored examples into the order that `read_back` needs."""
    return examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
