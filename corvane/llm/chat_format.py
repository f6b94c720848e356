"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to one string.  The prefixes of a conversation are rendered one after the other;
what an output adds to the one before it is the newest turn's span.  An output that doesn't begin with the one before it rewrites
history: that turn is recorded, and no turn up to it has a span (nor is it trained on), as what was said of it no longer stands.  Where a turn's text
lies inside its span is found from outside too: two renderings that differ in one character of the text differ exactly there.

Turns of one conversation are one row, since a formatted conversation is one string; conversations are spread by id.  Rendering
all prefixes costs the square of a conversation's turns in characters, but never more memory than a few outputs.

Defined cases: rows go by turn, ties by role and text, null first; null role or text is empty; a null conv_id is a conversation of its own;
repeated rows are repeated turns; an empty table formats nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.workspace import small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the instruction format.
BEGIN, END, INST, INST_END, SYS, SYS_END, OTHER, OTHER_END = "<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "[TURN ", " [/TURN]"
_CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[TURN|\[/TURN\]")
_ESCAPES = {"\\": "\\\\", "[": "\\(", "<": "\\{"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    """A text without any control string: the first character of each, and every backslash, is written as a pair."""
    return _CONTROL.sub(lambda m: _ESCAPES[m[0][0]] + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def instruct(turns: list[Turn]) -> str:
    """The instruction format: system, user and assistant turns by their own marks, other roles by name."""
    out = [BEGIN] if turns else []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"{INST}{text}{INST_END}")
        elif role == "assistant":
            out.append(f" {text} {END}")
        elif role == "system":
            out.append(f"{SYS}{text}{SYS_END}")
        else:
            out.append(f"{OTHER}{len(escape(role))}:{escape(role)}] {text}{OTHER_END}")
    return "".join(out)


def read_turn(span: str, content: str) -> Turn:
    """The turn that a span of the instruction format holds; content is the span's text part."""
    span = span.removeprefix(BEGIN)
    if span.startswith(INST):
        role = "user"
    elif span.startswith(SYS):
        role = "system"
    elif span.startswith(OTHER):
        size, rest = span[len(OTHER) :].split(":", 1)
        role = unescape(rest[: int(size)])
    else:
        role = "assistant"
    return role, unescape(content)


def _common(a: str, b: str, at: int) -> int:
    """The first place from `at` where a and b differ."""
    n = min(len(a), len(b))
    while at < n and a[at] == b[at]:
        at += 1
    return at


def incremental(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int] | None], list[int]]:
    """The formatted conversation; for each turn its span and its text's place, or None; and the turns that rewrote history."""
    before, spans, rewrote = "", [], []
    for i, (role, _) in enumerate(turns):
        after = template(turns[: i + 1])
        if not after.startswith(before):
            rewrote.append(i)
            spans = [None] * (i + 1)
        else:
            x, y = (template([*turns[:i], (role, mark)]) for mark in "xy")
            start = _common(x, y, min(len(before), len(x), len(y))) if x.startswith(before) and y.startswith(before) else None
            if start is None or len(x) != len(y) or x[start + 1 :] != y[start + 1 :]:
                spans.append(None)
            else:
                spans.append((len(before), len(after), start, len(after) - (len(x) - start - 1)))
        before = after
    return before, spans, rewrote


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and turns (turn, role, text), in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


SCHEMA = "conv_id long, formatted string, spans array<struct<role string, start int, end int, text_start int, text_end int>>, rewrites array<int>"


def formatted(rows: DataFrame, template: Template = instruct) -> DataFrame:
    """conv_id, formatted, spans (role, start, end, text_start, text_end; null ends where history was rewritten), rewrites (turns)."""
    small_batches(rows.sparkSession)
    span = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32())]))

    def run(batches):
        for batch in batches:
            out, places, rewrites = [], [], []
            for turns in batch.column(1):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                text, spans, rewrote = incremental(turns, template)
                out.append(text)
                places.append([dict(zip(("role", "start", "end", "text_start", "text_end"), (role, *(s or (None,) * 4)), strict=True)) for (role, _), s in zip(turns, spans, strict=True)])
                rewrites.append(rewrote)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(places, span), pa.array(rewrites, pa.list_(pa.int32()))], ["conv_id", "formatted", "spans", "rewrites"])

    return conversations_of(rows).mapInArrow(run, SCHEMA)


def digests(done: DataFrame) -> DataFrame:
    """What conversations in the instruction format say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    One with a turn whose span isn't known (its history was rewritten, or the text couldn't be told from its surroundings) can't be read back: digests
    and loss_chars are null.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text, whole, loss, chars = text.as_py(), hashlib.sha256(), hashlib.sha256(), 0
                spans = spans.as_py()
                if any(s["text_start"] is None for s in spans):
                    rows.append((len(spans), None, None, None, len(text)))
                    continue
                for s in spans:
                    content = text[s["text_start"] : s["text_end"]]
                    role, said = read_turn(text[s["start"] : s["end"]], content)
                    whole.update(f"{role}\n{said}\n".encode())
                    if s["role"] == "assistant":  # the mask of the loss
                        loss.update(said.encode())
                        chars += len(said)
                rows.append((len(spans), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return done.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
