"""Chat formatting by a finite-state machine over roles and a declarative template.

The rows of a conversation run through one task in turn order as a stream; only the machine's state is held, never
the conversation. A turn becomes text segments with a loss flag each. Control strings of the template that occur in texts are
broken by a backslash after their first character (and backslashes doubled), so the formatted text parses without doubt.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Markers around a turn, roles under the loss mask, and which role may follow which state.

    A state is the role seen last; START is the state before the first turn.
    """

    open: str = "<turn "
    open_end: str = ">\n"
    close: str = "</turn>\n"
    more_controls: tuple[str, ...] = ("### Assistant:", "### User:", "### System:", "<|endoftext|>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "START": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    finals: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        return sorted({self.open, self.close.rstrip("\n"), *self.more_controls}, key=len, reverse=True)


TEMPLATE = Template()
_SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escape(text: str, controls: re.Pattern) -> str:
    return controls.sub(lambda m: m[0] * 2 if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Drop every backslash but one that follows a dropped one."""
    return re.sub(r"\\(\\?)", r"\1", text)


def _controls(t: Template) -> re.Pattern:
    return re.compile("|".join([r"\\", *map(re.escape, t.controls)]))


def format_chat(rows: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, position from 0, segments, valid, last): a row per turn, each conversation's rows in order in one partition.

    ``valid`` is false from the turn on that the machine doesn't allow. ``last`` marks a conversation's last row, where ``valid`` also
    asks for a final state. Rows with a null conversation form one conversation; null turns come first; equal turns are ordered by
    role, then text. A null role or text counts as empty. Invalid conversations are formatted like others: the caller decides. Other columns are not read.
    """
    kind = dict(rows.dtypes)[conv]
    src = rows.select(F.col(conv).alias("__c"), F.col(turn).alias("__t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("__r"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__x"))
    src = src.repartition("__c").sortWithinPartitions("__c", "__t", "__r", "__x").select("__c", "__r", "__x")
    arrow = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        controls, name = _controls(template), re.compile(r"[\\>]")
        now, state, ok, at, waiting, first, kept = None, "START", True, 0, None, True, None
        for b in batches:
            out = []
            for c, r, x in zip(*(col.to_pylist() for col in b.columns)):
                if first or c != now:
                    if waiting is not None:
                        out.append((*waiting[:3], waiting[3] and state in template.finals, True))
                        waiting = None
                    now, state, ok, at, first = c, "START", True, 0, False
                if waiting is not None:
                    out.append((*waiting, False))
                ok, state = ok and r in template.follows.get(state, ()), r
                head = template.open + name.sub(r"\\\g<0>", r) + template.open_end
                segments = [(head, False), (escape(x, controls), r in template.loss_roles), (template.close, False)]
                waiting, at = (c, at, segments, ok), at + 1
            kept = b.schema.field(0).type
            if out:
                yield batch(out, kept)
        if waiting is not None:
            yield batch([(*waiting[:3], waiting[3] and state in template.finals, True)], kept)

    def batch(out: list[tuple], kind_) -> pa.RecordBatch:
        c, at, seg, ok, last = zip(*out)
        seg = [[{"text": t, "loss": loss} for t, loss in s] for s in seg]
        return pa.RecordBatch.from_arrays([pa.array(c, kind_), pa.array(at, pa.int64()), pa.array(seg, arrow), pa.array(ok), pa.array(last)],
                                          [conv, "position", "segments", "valid", "last"])

    return src.mapInArrow(run, f"`{conv}` {kind}, position long, segments {_SEGMENTS}, valid boolean, last boolean")


def parse_turn(formatted: str, t: Template = TEMPLATE) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    m = re.match(re.escape(t.open) + r"((?:[^\\>]|\\.)*)" + re.escape(t.open_end), formatted, re.S)
    if not m or not formatted.endswith(t.close):
        raise ValueError("not a formatted turn")
    return re.sub(r"\\(.)", r"\1", m[1], flags=re.S), unescape(formatted[m.end():len(formatted) - len(t.close)])


def read_back(formatted: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id") -> DataFrame:
    """What format_chat's rows say, from their segments alone: a row per conversation.

    n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and loss_sha256 (all unescaped text under the loss
    mask), formatted_chars, valid. Works on the order that format_chat leaves; digests run on, so no conversation is held.
    """
    kind = dict(formatted.dtypes)[conv]
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = chars = loss_chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for b in batches:
            out = []
            for c, segments, ok, last in zip(*(col.to_pylist() for col in b.columns)):
                role, text = parse_turn("".join(s["text"] for s in segments), template)
                turns.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    chars += len(s["text"])
                    if s["loss"]:
                        plain = unescape(s["text"])
                        loss_chars += len(plain)
                        loss.update(plain.encode())
                n += 1
                if last:
                    out.append((c, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, ok))
                    n = chars = loss_chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(x) for x in cols[1:])], names)

    return formatted.select(conv, "segments", "valid", "last").mapInArrow(
        run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
