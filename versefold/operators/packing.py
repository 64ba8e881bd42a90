"""Order-dependent folds: packing sentences and merging small pieces.

The folds carry a buffer from sentence to sentence, which no window or join expresses; a native aggregate() copies its
output at each step and inlines its input. So they run over Arrow batches, a row for each packable unit: no shuffle,
memory bounded by a batch, and units are independent because nothing is packed or merged across a section's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schema import HARD_SPLIT_CHARS, MAX_CHARS, MIN_CHARS, TARGET_CHARS

PARAGRAPH, MIDDLE, SECTION = "ends_paragraph", "mid_paragraph", "ends_section"

PIECE = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("over_cap", T.BooleanType()), T.StructField("boundary", T.StringType()), T.StructField("kind", T.StringType())])


def expand(df: DataFrame, columns: list[str], fn: Callable[..., Iterable[tuple]], out: T.StructType, keep: list[str]) -> DataFrame:
    """A row (*keep, *out) for each tuple that fn makes of a row's columns."""
    schema = T.StructType([df.schema[c] for c in keep] + out.fields)
    arrow = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
    kinds = [arrow[f.dataType] for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            made: list[tuple] = []
            for r, values in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
                before = len(made)
                made.extend(fn(*values))
                rows.extend([r] * (len(made) - before))
            index = pa.array(rows, pa.int64())
            values = list(zip(*made, strict=True)) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(index) for c in keep] + [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=schema.names)

    return df.mapInArrow(run, schema)


def cut_long(sentence: str, limit: int) -> list[str]:
    """As functions.text.split_long."""
    if len(sentence) <= limit:
        return [sentence]
    marks = [i for i, c in enumerate(sentence) if c in ",;:"]
    if not marks:
        return [sentence]
    at = min(marks, key=lambda i: (abs(i - len(sentence) / 2), i)) + 1
    sides = [sentence[:at].strip(), sentence[at:].strip()]
    return sides if all(sides) else [sentence]


class Buffer:
    """Sentences that wait to be joined, with the length they will have."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0

    def with_one(self, sentence: str) -> int:
        return self.size + len(sentence) + (1 if self.parts else 0)

    def add(self, sentence: str) -> None:
        self.size = self.with_one(sentence)
        self.parts.append(sentence)

    def take(self) -> str:
        text = " ".join(self.parts)
        self.parts, self.size = [], 0
        return text


def packed(sentences: Iterable[str], target: int, cap: int) -> Iterator[str]:
    """Sentences joined to texts: one is closed before it would go over the cap, and once it has reached the target."""
    held = Buffer()
    for s in sentences:
        if held.parts and held.with_one(s) > cap:
            yield held.take()
        held.add(s)
        if held.size >= target:
            yield held.take()
    if held.parts:
        yield held.take()


def packed_paragraphs(paragraphs: list[list[str]], target: int, cap: int, least: int, limit: int) -> Iterator[tuple[str, str]]:
    """(text, boundary) of a unit: as packed(), but a paragraph's end closes what has the least size, before the target is looked at."""
    held = Buffer()
    for sentences in paragraphs:
        parts = [p for s in sentences for p in cut_long(s, limit)]
        for k, s in enumerate(parts, 1):
            if held.parts and held.with_one(s) > cap:
                yield held.take(), MIDDLE
            held.add(s)
            if k == len(parts) and held.size >= least:
                yield held.take(), PARAGRAPH
            elif held.size >= target:
                yield held.take(), MIDDLE
    if held.parts:
        yield held.take(), PARAGRAPH


def merged(items: Iterable[tuple[str, bool, str, str]], least: int, cap: int) -> Iterator[tuple[str, bool, str, str]]:
    """(text, over_cap, boundary, kind) with small bodies joined to the smaller neighbour (the one before, on a tie).

    A single pass with the last two items held is the fixed point of merging again and again from the start: what lies
    before them can't merge any more, as merging only lengthens a neighbour. Nothing is joined over the cap, across a
    section's end, or with a title.
    """

    def join(a: tuple, b: tuple) -> tuple:
        text = f"{a[0]} {b[0]}"
        return text, len(text) > cap, b[2], "body"

    def open_(a: tuple | None, b: tuple | None) -> bool:
        return a is not None and b is not None and "title" not in (a[3], b[3]) and a[2] != SECTION and len(a[0]) + 1 + len(b[0]) <= cap

    before: Any = None
    here: Any = None
    for item in [*items, None]:
        while here is not None and here[3] != "title" and len(here[0]) < least:
            to_left, to_right = open_(before, here), open_(here, item)
            if to_left and (not to_right or len(before[0]) <= len(item[0])):
                here, before = join(before, here), None
            elif to_right:
                here, item = join(here, item), None
                break
            else:
                break
        if item is None and here is not None:
            continue
        if before is not None:
            yield before
        before, here = here, item
    if before is not None:
        yield before
    if here is not None:
        yield here


def greedy_pack(df: DataFrame, sentences: str, keep: list[str], *, target: int = TARGET_CHARS, cap: int = MAX_CHARS, limit: int | None = HARD_SPLIT_CHARS) -> DataFrame:
    """A row (*keep, idx, text, over_cap) for each pack of an array of sentences; with a limit, longer sentences are cut first."""
    out = T.StructType(PIECE.fields[:3])

    def fn(array: list[str] | None) -> Iterator[tuple]:
        parts = array or [] if limit is None else [p for s in array or [] for p in cut_long(s, limit)]
        for k, text in enumerate(packed(parts, target, cap)):
            yield k, text, len(text) > cap

    return expand(df, [sentences], fn, out, keep)


def pack_units(df: DataFrame, paragraphs: str, keep: list[str], *, target: int = TARGET_CHARS, cap: int = MAX_CHARS, least: int = MIN_CHARS, limit: int = HARD_SPLIT_CHARS, merge: bool = True, close: bool = True, title: str | None = None) -> DataFrame:
    """A row (*keep, idx, text, over_cap, boundary, kind) for each piece of a unit, an array of paragraphs that are arrays of sentences.

    close: the unit's last piece ends a section. merge: small pieces are joined with a neighbour. title: a column that
    is below 0 for units that are titles, which stay as they are.
    """

    def fn(unit: list[list[str]] | None, at: int = 0) -> Iterator[tuple]:
        if at < 0:
            yield 0, unit[0][0], False, SECTION, "title"
            return
        pieces = [(t, len(t) > cap, b, "body") for t, b in packed_paragraphs(unit or [], target, cap, least, limit)]
        if close and pieces:
            pieces[-1] = (*pieces[-1][:2], SECTION, "body")
        for k, piece in enumerate(merged(pieces, least, cap) if merge else pieces):
            yield k, *piece

    return expand(df, [paragraphs, *([title] if title else [])], fn, PIECE, keep)


def merge_small(df: DataFrame, items: str, keep: list[str], *, least: int = MIN_CHARS, cap: int = MAX_CHARS) -> DataFrame:
    """As pack_units, from an array of structs (text, over_cap, boundary, kind) in order."""

    def fn(rows: list[dict] | None) -> Iterator[tuple]:
        for k, piece in enumerate(merged([(r["text"], r["over_cap"], r["boundary"], r["kind"]) for r in rows or []], least, cap)):
            yield k, *piece

    return expand(df, [items], fn, PIECE, keep)
