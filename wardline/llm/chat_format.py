"""Conversations formatted by a compiled template, with the spans that a loss counts.

Rows are dealt by conversation and sorted by turn; each task renders its conversations message by message, so a
conversation of any length needs the memory of one message. One output row is one message: its place, its text
and the character spans under the generation mark. ``read_back`` parses the formatted text alone, chunk by chunk.

Control strings in texts are escaped by one backslash before them and before the backslashes in front of them;
taking one backslash away from every such run gives back the text. A control string of the template always stands
at the start of a chunk or behind a line break, never behind a backslash, so the two cannot be confused.

Defined results: rows go by turn, then role, then text (null first); null texts and roles are empty; a null id is a
conversation of its own; repeated rows stay; an empty table gives an empty result; other columns are ignored,
whatever their names. One conversation is hashed in order, so a hot one is one task's stream, at constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.chat_template import compile_template

CONTROL = r"\\*</?turn>"
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | field }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '\\n' }}</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    return re.sub(CONTROL, lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\" + CONTROL, lambda m: m[0][1:], text)


def field(text: str) -> str:
    """A text without line breaks and control strings, for a header."""
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unfield(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), text)


FILTERS = {"escape": escape, "field": field, "upper": str.upper, "lower": str.lower, "trim": str.strip}
CHUNKS = "conv_id long, place long, formatted string, spans array<struct<start:int,end:int>>"


def format_conversations(
    rows: DataFrame, template: str = TEMPLATE, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """One row a message: ``conv_id, place, formatted, spans``; a conversation's text is its chunks in order of place.

    Chunks of a conversation stay in one partition, in order.
    """
    compile_template(template, FILTERS)  # a wrong template fails here, not in the tasks
    narrow = rows.select(
        F.col(id_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    sorted_rows = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template, FILTERS)

        def chunks() -> Iterator[tuple]:
            for conv_id, turns in groupby(_tuples(batches), key=lambda r: r[0]):
                messages = ({"turn": r[1], "role": r[2], "text": r[3]} for r in turns)
                for place, (text, spans) in enumerate(render(messages)):
                    yield conv_id, place, text, [{"start": a, "end": b} for a, b in spans]

        yield from _frames(chunks(), ["conv_id", "place", "formatted", "spans"])

    return sorted_rows.mapInPandas(render_all, CHUNKS)


def _tuples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        ids = [None if pd.isna(x) else int(x) for x in batch.iloc[:, 0]]
        yield from zip(ids, *(batch.iloc[:, i] for i in range(1, batch.shape[1])), strict=True)


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, 1000)):
        frame = pd.DataFrame(part, columns=names)
        yield frame.astype({names[0]: "Int64"})


MESSAGE = re.compile(r"<turn>([^\n]*)\n(.*?)\n</turn>\n", re.S)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts of each conversation, parsed from the formatted chunks of the default template, as digests.

    Expects the chunks as ``format_conversations`` leaves them: a conversation in one partition, in order of place.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def conversations() -> Iterator[tuple]:
            for conv_id, chunks in groupby(_tuples(batches), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                count = loss_chars = chars = 0
                for _, _, text, spans in chunks:
                    chars += len(text)
                    for found in MESSAGE.finditer(text):
                        count += 1
                        turns.update(f"{unfield(found[1])}\n{unescape(found[2])}\n".encode())
                    for span in spans:
                        said = unescape(text[span["start"] : span["end"]])
                        loss_chars += len(said)
                        loss.update(said.encode())
                yield conv_id, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _frames(conversations(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(digest, DIGEST)
