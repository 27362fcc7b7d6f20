"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text. It is not looked into: successive prefixes
of a conversation are rendered and consecutive outputs compared. Where each output begins with the
one before, the added part is the turn's span; where one doesn't, the template rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import small_batches

Turn = tuple[str, str]  # role, text
Template = Callable[[Sequence[Turn]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"[\\\n]")


def escape(text: str) -> str:
    """No `<|` is left: every `<`, backslashes, `|` gets one more backslash. unescape() takes it away again."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(_ROLE.sub(lambda m: "\\\\" if m[0] == "\\" else "\\n", role))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chat_template(turns: Sequence[Turn]) -> str:
    """The engine's own template: `<|im_start|>role`, newline, text, `<|im_end|>`, newline for each turn."""
    return "".join([f"{OPEN}{_escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns])


class Rendered(NamedTuple):
    text: str  #: the whole conversation's rendering
    spans: list[tuple[int, int]]  #: of each turn in it; empty if history is rewritten
    rewrites_at: int  #: first turn whose rendering changed what stood before it; -1 if none


def render(turns: Sequence[Turn], template: Template = chat_template) -> Rendered:
    """Spans of the turns, found only from the template's outputs on successive prefixes."""
    before = template([])
    spans: list[tuple[int, int]] = []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            return Rendered(template(turns), [], k - 1)
        spans.append((len(before), len(now)))
        before = now
    return Rendered(before, spans, -1)


def read_turn(span: str) -> tuple[Turn, tuple[int, int]]:
    """The turn that chat_template() wrote in a span, and the bounds of its (escaped) text there."""
    if not (span.startswith(OPEN) and span.endswith(CLOSE + "\n")):
        raise ValueError("the span isn't one rendered turn")
    end, at = len(span) - len(CLOSE) - 1, span.index("\n") + 1
    return (_unescape_role(span[len(OPEN) : at - 1]), unescape(span[at:end])), (at, end)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>) in turn order; ties by role, then text; null turns first."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, template: Template = chat_template, keep: bool = False) -> DataFrame:
    """One row for each conversation, all of it read back from the formatted output.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_at; with keep also
    formatted and loss_spans (array of [from, to) code points of the loss mask: the assistant texts).

    A null role or text counts as empty. Rows without conv_id form one conversation of that id. Repeated
    rows are turns of their own. No rows, no conversations; extra columns are ignored. A template that
    rewrites history gives rewrites_at >= 0, no spans, and null digests: its turns can't be masked.

    A conversation is one string, so it has to fit a task; prefixes are rendered one at a time.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_formatted([(t["role"], t["text"]) for t in turns], template) for turns in batch.column("turns").to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))][: 8 if keep else 6]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], ["conv_id", *_COLUMNS[: len(kinds)]])

    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_at long"
    return conversations(rows).mapInArrow(run, schema + (", formatted string, loss_spans array<array<long>>" if keep else ""))


_COLUMNS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_at", "formatted", "loss_spans"]


def _formatted(turns: list[Turn], template: Template) -> tuple:
    done = render(turns, template)
    if done.rewrites_at >= 0:
        return (len(turns), None, None, None, len(done.text), done.rewrites_at, done.text, [])
    every, loss, chars, masks = hashlib.sha256(), hashlib.sha256(), 0, []
    for a, b in done.spans:
        (role, text), (at, end) = read_turn(done.text[a:b])
        every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == LOSS_ROLE:
            loss.update(text.encode("utf-8", "surrogatepass"))
            chars += len(text)
            masks.append([a + at, a + end])
    return (len(done.spans), every.hexdigest(), chars, loss.hexdigest(), len(done.text), -1, done.text, masks)
