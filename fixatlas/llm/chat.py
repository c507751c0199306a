"""Conversations as training text, with spans found by rendering prefixes.

The template is a black box from turns to text. The first turn alone is rendered, then the
first two, and so on; what each output has beyond the one before is the turn's span. A turn's
text lies in its span where two renderings of the same prefix, with other last texts, differ.
If an output does not begin with the one before, the template rewrites history: the first
such turn is reported and the conversation has no spans, for none would hold.

Defined cases: null text or role is empty; turns of one conversation come in the order of
turn, role and text, with all repeated rows; a null ``conv_id`` is a conversation of its own;
columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed strings that the marks of turns use or that models treat as marks.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN "]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_BACKSLASHES = re.compile(r"\\(\\?)")

RESULT = """conv_id long, formatted string, rewritten_at int,
  spans array<struct<role: string, start: int, end: int, text_start: int, text_end: int>>"""


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACKSLASHES.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    """``[TURN "role"]``, line feed, escaped text, ``</s>``, line feed, for each turn."""
    return "".join(f"[TURN {json.dumps(role)}]\n{escape(text)}</s>\n" for role, text in turns)


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) >> 1
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def locate(turns: list[tuple[str, str]], template=render):
    """The output, spans (role, start, end, text start, text end), and the turn that rewrites."""
    before, spans = template([]) if turns else "", []
    for k, (role, text) in enumerate(turns):
        out = template(turns[: k + 1])
        if not out.startswith(before):
            return template(turns), None, k
        one, other = (template([*turns[:k], (role, probe)])[len(before) :] for probe in ("a", "b"))
        head = _common(one, other)
        tail = _common(one[::-1], other[::-1])
        spans.append((role, len(before), len(out), len(before) + head, len(out) - tail))
        before = out
    return before, spans, None


def format_conversations(rows: DataFrame, template=render) -> DataFrame:
    """One row per conversation: conv_id, formatted, rewritten_at (null if never), spans."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = {"conv_id": part.column("conv_id"), "formatted": [], "rewritten_at": [], "spans": []}
                for turns in part.column("turns").to_pylist():
                    text, spans, at = locate([(t["role"], t["text"]) for t in turns], template)
                    out["formatted"].append(text)
                    out["rewritten_at"].append(at)
                    names = ("role", "start", "end", "text_start", "text_end")
                    out["spans"].append(None if spans is None else [dict(zip(names, s)) for s in spans])
                yield pa.RecordBatch.from_pydict(
                    out, pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("rewritten_at", pa.int32()), ("spans", _SPANS)])
                )

    return whole.mapInArrow(run, RESULT)


_SPANS = pa.list_(
    pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end"))])
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text as they stand in the output: conv_id, turns, loss, formatted.

    Roles come from the marks in the output, texts from under the spans; the loss mask covers
    the texts of turns marked ``assistant``. A rewritten conversation has null turns and loss.
    """
    schema = "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss string"
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            all_turns, losses = [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                if spans is None:
                    all_turns.append(None)
                    losses.append(None)
                    continue
                found = []
                for s in spans:
                    mark = text[s["start"] : s["text_start"]]
                    role = json.loads(mark.removeprefix("[TURN ").removesuffix("]\n"))
                    found.append({"role": role, "text": unescape(text[s["text_start"] : s["text_end"]])})
                all_turns.append(found)
                losses.append("".join(t["text"] for t in found if t["role"] == "assistant"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("formatted"), pa.array(all_turns, turns), pa.array(losses, pa.string())],
                ["conv_id", "formatted", "turns", "loss"],
            )

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, schema)
