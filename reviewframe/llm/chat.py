"""Prefix-target expansion of conversations into training examples.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text
trainable. A conversation that doesn't end in an assistant turn gets one more example with nothing to
train on, so that its last turns are kept as well.

Template: an assistant turn is ``<s>text</s>``, any other ``<s>[INST] role`` newline ``text [/INST]</s>``.
Control strings inside roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so ``parse`` gives back what ``render`` was given, whatever it holds.

Turns are dealt by conversation and sorted on disk; a task walks them one after another and holds one
conversation's prefix, written once, and the example at hand. Rows are ordered by turn, ties by role and
text; null turns come first, null roles and texts are empty. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepared

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
ASSISTANT = "assistant"
_ESCAPE = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_UNESCAPE = re.compile(r"\\(\\?)")
_ROLE_UNESCAPE = re.compile(r"\\(\\|n|)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ROLE_UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> str:
    if role == ASSISTANT:
        return BEGIN + escape(text) + END
    return BEGIN + OPEN + escape_role(role) + "\n" + escape(text) + CLOSE + END


def parse(example: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    turns = []
    for body in example[len(BEGIN):-len(END)].split(END + BEGIN) if example else []:
        if body.startswith(OPEN):
            role, _, text = body[len(OPEN):-len(CLOSE)].partition("\n")
            turns.append((unescape_role(role), unescape(text)))
        else:
            turns.append((ASSISTANT, unescape(body)))
    return turns


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()),
                       ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_EXAMPLES_DDL = "conv_id long, example long, formatted string, loss_start long, loss_end long"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conversation, begun = None, False
    prefix, number, trained = "", 0, True
    rows: list[tuple] = []
    size = 0

    def context_only() -> list[tuple]:
        return [(conversation, number, prefix, len(prefix), len(prefix))] if begun and not trained else []

    for b in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if not begun or conv != conversation:
                rows += context_only()
                conversation, begun, prefix, number = conv, True, "", 0
            turn = render(role, text)
            trained = role == ASSISTANT
            if trained:
                start = len(prefix) + len(BEGIN)
                rows.append((conv, number, prefix + turn, start, start + len(turn) - len(BEGIN) - len(END)))
                number += 1
                size += len(prefix)
            prefix += turn
            if size > 4_000_000 or len(rows) >= 2048:
                yield batch(_EXAMPLES, list(zip(*rows)))
                rows, size = [], 0
    rows += context_only()
    if rows:
        yield batch(_EXAMPLES, list(zip(*rows)))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): one row for each assistant turn.

    The examples of a conversation follow one another in one partition; the loss span is in characters
    of ``formatted``.
    """
    prepared(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_expand, _EXAMPLES_DDL)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict | None = None

    def finish(s: dict) -> tuple:
        turns = parse(s["last"])
        digest = hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        return (s["conv"], len(turns), digest.hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"])

    for b in batches:
        rows = []
        for conv, example, formatted, start, end in zip(*(c.to_pylist() for c in b.columns)):
            if state is None or example == 0:
                if state is not None:
                    rows.append(finish(state))
                state = {"conv": conv, "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
            text = unescape(formatted[start:end])
            state["loss"].update(text.encode())
            state["chars"] += len(text)
            state["formatted"] += len(formatted)
            state["last"] = formatted
        if rows:
            yield batch(_DIGESTS, list(zip(*rows)))
    if state is not None:
        yield batch(_DIGESTS, [[x] for x in finish(state)])


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from the output of ``expand`` alone, in its partitions' order."""
    return examples.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                           "loss_sha256 string, formatted_chars long")
