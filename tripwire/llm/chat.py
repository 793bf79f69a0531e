"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags by segment.

Each turn becomes the text segments header, body, end. Control strings inside bodies and role names are escaped by
a backslash, and so is the backslash, so that ``read_back`` recovers every turn from the formatted text alone.

Edge cases: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one order and all stay; a null conv_id is one conversation; an order of roles that the machine
rejects is formatted all the same, with ``valid`` false and the first offending position in ``rejected_at``; an empty
table gives an empty result; other columns are ignored. A conversation is one row, so it must fit in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.llm.batches import release


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles bear loss, and which role may follow which ('' stands for the beginning)."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = " </turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def escape(self, text: str, more: str = "") -> str:
        marks = "|".join(map(re.escape, ("\\", *self.control, *more)))
        return re.sub(marks, lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        marks = "|".join(map(re.escape, ("\\", *self.control, ":")))
        return re.sub(rf"\\({marks})", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, whether it bears loss) of one turn."""
        title = self.titles.get(role)
        if title is None:  # a role that is spelled like another's title is told apart by an escape
            title = ("\\:" if role in self.titles.values() else "") + self.escape(role, ":")
        return [(self.opening + title + self.after_role, False), (self.escape(text), role in self.loss_roles), (self.closing, False)]

    def first_rejected(self, roles: list[str]) -> int:
        """The first position that the machine rejects, or -1."""
        state = ""
        for k, role in enumerate(roles):
            if role not in self.follows.get(state, ()):
                return k
            state = role
        return -1

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation."""
        marks = "|".join(map(re.escape, ("\\", *self.control, ":")))
        inside = rf"(?:\\(?:{marks})|(?!{'|'.join(map(re.escape, self.control))})[^\\])*?"
        turn = re.compile(rf"{re.escape(self.opening)}({inside}){re.escape(self.after_role)}({inside}){re.escape(self.closing)}", re.S)
        names, out, at = {v: k for k, v in self.titles.items()}, [], 0
        while at < len(formatted):
            if not (m := turn.match(formatted, at)):
                raise ValueError(f"no turn at position {at}")
            raw = m[1]
            role = names[raw] if raw in names else self.unescape(raw.removeprefix("\\:") if raw.removeprefix("\\:") in names else raw)
            out.append((role, self.unescape(m[2])))
            at = m.end()
        return out


FORMATTED = "conv_id long, formatted string, valid boolean, rejected_at int, segments array<struct<text: string, loss: boolean>>"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: its formatted text, the verdict of the machine, and its segments with loss flags."""
    template = template or Template()
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row"), lambda a, b: _order(a, b)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            made, wrong = [], []
            for turns in batch.column("rows").to_pylist():
                made.append([x for t in turns for x in template.segments(t["role"], t["text"])])
                wrong.append(template.first_rejected([t["role"] for t in turns]))
            segments = pa.array([[{"text": t, "loss": x} for t, x in own] for own in made], pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))
            columns = [pa.array(["".join(t for t, _ in own) for own in made], pa.string()), pa.array([x < 0 for x in wrong], pa.bool_()), pa.array(wrong, pa.int32()), segments]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "formatted", "valid", "rejected_at", "segments"])

    return grouped.mapInArrow(run, FORMATTED)


def _order(a, b):
    """Compares rows by (turn, role, text), null turns first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


READ = "conv_id long, turns array<struct<role: string, text: string>>, loss_texts array<string>"


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns that the formatted text holds, and the unescaped texts of the segments that bear loss."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            turns = [[{"role": r, "text": t} for r, t in template.turns(x)] for x in batch.column("formatted").to_pylist()]
            loss = [[template.unescape(x["text"]) for x in own if x["loss"]] for own in batch.column("segments").to_pylist()]
            columns = [pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(loss, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "turns", "loss_texts"])

    return formatted.select("conv_id", "formatted", "segments").mapInArrow(run, READ)


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, what is read back from its formatted text."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            formatted = batch.column("formatted").to_pylist()
            turns = [template.turns(x) for x in formatted]
            loss = ["".join(template.unescape(s["text"]) for s in own if s["loss"]) for own in batch.column("segments").to_pylist()]
            columns = [
                pa.array([len(x) for x in turns], pa.int64()), pa.array(["".join(f"{r}\n{t}\n" for r, t in x) for x in turns], pa.string()),
                pa.array(loss, pa.string()), pa.array([len(x) for x in formatted], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, batch.column("valid"), batch.column("rejected_at")], names=["conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars", "valid", "rejected_at"])

    made = format_conversations(conversations, template).mapInArrow(run, "conv_id long, n_turns long, turns_text string, loss_text string, formatted_chars long, valid boolean, rejected_at int")
    return made.select("conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid", "rejected_at")
