"""Delivery tags: responses, validation, coverage, review, and the interface of tag backends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import MALFORMED, NOT_ASKED, rejection
from ..functions.text import preview
from ..schema import TAG_ITEMS

TagFn = Callable[[list[dict]], dict[str, str]]


# The form of an answer that a backend is asked for.
ANSWER_SCHEMA = {
    "type": "object",
    "properties": {"items": {"type": "array", "items": {"type": "object", "properties": {"chunk_id": {"type": "string"}, "tag": {"type": "string"}}, "required": ["chunk_id", "tag"]}}},
    "required": ["items"],
}


def strict(schema: dict | list) -> dict | list:
    """A copy of a JSON schema in which no object may have further members."""
    if isinstance(schema, list):
        return [strict(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict(v) for k, v in schema.items()}
    return out | {"additionalProperties": False} if schema.get("type") == "object" else out


@F.pandas_udf(T.StringType())
def json_string(texts: pd.Series) -> pd.Series:
    """A text as a JSON string in ASCII. to_json leaves other characters as they are, and escaping them one by one in expressions takes ten times as long as this."""
    return texts.map(lambda t: None if t is None else json.dumps(t))


def tag_prompt(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, prompt): a line {"chunk_id": ..., "text": ...} for each chunk of a batch, in brackets. Fixed form; texts are in ASCII."""
    line = F.concat(F.lit('{"chunk_id": "'), F.col("chunk_id"), F.lit('", "text": '), json_string(F.col("text")), F.lit("}"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("position", "chunk_id", line.alias("l")))), lambda x: x["l"])
    return chunks.groupBy(*keep).agg(F.concat(F.lit("[\n  "), F.array_join(rows, ",\n  "), F.lit("\n]")).alias("prompt"))


def parse_response(responses: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(*keep, item, chunk_id, tag) for each item of answers {"items": [...]}, fenced or not; none for what can't be read."""
    plain = F.trim(F.replace(F.replace(F.col(text), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    parsed = F.coalesce(F.from_json(F.col(text), TAG_ITEMS)["items"], F.from_json(plain, TAG_ITEMS)["items"])
    return responses.select(*keep, F.posexplode(parsed).alias("item", "_i")).select(*keep, "item", "_i.chunk_id", "_i.tag")


def validate_response(items: DataFrame, chunks: DataFrame, keep: list[str]) -> DataFrame:
    """items (*keep, item, chunk_id, tag) with reason (null: accepted): malformed, unknown chunk, or the tag's own."""
    known = chunks.select(*keep, "chunk_id", F.col("text").alias("_text"))
    joined = items.join(known, [*keep, "chunk_id"], "left")
    reason = (
        F.when((F.coalesce("chunk_id", F.lit("")) == "") | F.col("tag").isNull(), MALFORMED)
        .when(F.col("_text").isNull(), NOT_ASKED)
        .otherwise(rejection(F.col("tag"), F.col("_text")))
    )
    return joined.select(*keep, "item", "chunk_id", "tag", reason.alias("reason"))


def accepted(validated: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, chunk_id, tag) of accepted items; of an id's several, the last."""
    good = validated.where(F.col("reason").isNull())
    return good.groupBy(*keep, "chunk_id").agg(F.max_by("tag", "item").alias("tag"))


def merge_tags(*maps: DataFrame, on: list[str]) -> DataFrame:
    """Tags of several tables; where a key is in several, the later table's."""
    every = None
    for k, m in enumerate(maps):
        part = m.select(*on, "tag", F.lit(k).alias("_k"))
        every = part if every is None else every.unionByName(part)
    return merged(every, on, "_k")


def merged(rows: DataFrame, on: list[str], order: str) -> DataFrame:
    """(*on, tag): of a key's tags that of the largest order."""
    return rows.groupBy(*on).agg(F.max_by("tag", order).alias("tag"))


def with_tags(chunks: DataFrame, tags: DataFrame, on: list[str]) -> DataFrame:
    """chunks with the tag of a table of accepted ones, null where there is none."""
    return chunks.drop("tag").join(tags.select(*on, "tag"), on, "left")


def review(chunks: DataFrame, on: list[str], n: int = 60) -> DataFrame:
    """(*on, text_preview, tag) of all chunks (with tag, null where none was accepted)."""
    return chunks.select(*on, preview(F.col("text"), n).alias("text_preview"), "tag")


def coverage(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, tagged_count, dropped_count) of chunks with tag: dropped are all without one, rejected or never proposed."""
    return chunks.groupBy(*by).agg(F.count_if(F.col("tag").isNotNull()).alias("tagged_count"), F.count_if(F.col("tag").isNull()).alias("dropped_count"))


def latest_tags(rows: DataFrame, on: list[str], order: str) -> DataFrame:
    """A tag table without null and empty tags; of duplicates, the last."""
    last = Window.partitionBy(*on).orderBy(F.desc(order))
    return rows.where("tag is not null and tag <> ''").withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*on, "tag")


def backends() -> dict[str, Callable[[], TagFn]]:
    """The tag backends that work offline, by name. Networked ones are registered by their users."""
    return dict(sorted(_BACKENDS.items()))


def register_backend(name: str, make: Callable[[], TagFn]) -> None:
    _BACKENDS[name] = make


def _by_mark() -> TagFn:
    """Tags by the text's last mark: a stand-in that needs no network."""
    marks = {"!": "urgent", "?": "hesitant"}
    return lambda batch: {c["chunk_id"]: marks[c["text"].rstrip("\"'”’)]")[-1:]] for c in batch if c["text"].rstrip("\"'”’)]")[-1:] in marks}


_BACKENDS: dict[str, Callable[[], TagFn]] = {"by-mark": _by_mark, "none": lambda: lambda batch: {}}


def get_backend(name: str) -> TagFn:
    """The backend of a name; `auto` is the first registered one beyond the two that come along, or none."""
    if name == "auto":
        name = next((n for n in backends() if n not in ("by-mark", "none")), "none")
    if name not in _BACKENDS:
        raise KeyError(f"no tag backend {name!r}; there are: {', '.join(backends())}")
    return _BACKENDS[name]()


def response_text(payload: Column) -> Column:
    """The answer's text in a response object as JSON: its output_text, else the first text within its output; null without one."""
    deep = F.from_json(payload, "output array<struct<content array<struct<text string>>>>")["output"]
    texts = F.flatten(F.transform(deep, lambda o: F.transform(F.coalesce(o["content"], F.array()), lambda c: c["text"])))
    first = F.get(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))
    return F.coalesce(F.nullif(F.get_json_object(payload, "$.output_text"), F.lit("")), first)


def propose_tags(chunks: DataFrame, tag: TagFn, on: list[str]) -> DataFrame:
    """(*on, tag) of what a backend proposes, called with a batch of {chunk_id, text} at a time. A call that fails proposes nothing.

    chunk_id must be unique within a partition's batch; rows carry their other keys through.
    """
    schema = ", ".join(f"{c} {dict(chunks.dtypes)[c]}" for c in on) + ", tag string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [str(k) for k in range(len(frame))]
            try:
                got = tag([{"chunk_id": k, "text": t} for k, t in zip(keys, frame["text"], strict=True)])
            except Exception:  # noqa: BLE001  a backend is optional by contract
                got = {}
            out = frame[on].copy()
            out["tag"] = [got.get(k) for k in keys]
            yield out[out["tag"].notna()]

    return chunks.select(*on, "text").mapInPandas(run, schema)
