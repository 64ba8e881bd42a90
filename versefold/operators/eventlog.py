"""The event log: rows for each kind of event, as JSON lines, with key-shaped values set apart; progress by chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_shaped
from ..schema import EVENT, EVENT_KINDS

#: Fields of each kind, in the order of its line.
FIELDS = {
    "run_started": ["book", "chapters", "tagger"],
    "chunked": ["chapter_id", "chunk_count"],
    "tagged": ["chapter_id", "tagged_count", "dropped_count"],
    "chunk_done": ["chunk_id", "i", "n", "latency_s", "concurrency"],
    "chunk_failed": ["chunk_id", "i", "n", "error"],
    "concurrency_changed": ["from", "to", "reason"],
    "stitched": ["chapter_id", "path", "duration_s"],
    "done": ["book", "chapters_done", "failed_chunks"],
    "error": ["message"],
}


def event(kind: str, **values: Column) -> Column:
    """One event as a struct of the log's schema. A field named `from` is given as from_."""
    given = {k.rstrip("_"): v for k, v in values.items()}
    if kind not in EVENT_KINDS or set(given) - set(FIELDS[kind]):
        raise ValueError(f"{kind} has no such fields: {sorted(given)}")
    return F.struct(*[(F.lit(kind) if f.name == "event" else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def line(kind: str, **values: Column) -> Column:
    """One event as a JSON line with its own fields only, nulls included."""
    given = {k.rstrip("_"): v for k, v in values.items()}
    order = [f for f in FIELDS[kind] if f in given]
    return F.to_json(F.struct(F.lit(kind).alias("event"), *[given[f].alias(f) for f in order]), {"ignoreNullFields": "false"})


def suspicious(df: DataFrame) -> Column:
    """Whether any string in a row, however deep, is key-shaped."""

    def of(value: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StringType):
            return key_shaped(value)
        if isinstance(kind, T.ArrayType):
            inner = F.exists(value, lambda x: c if (c := of(x, kind.elementType)) is not None else F.lit(False))
            return F.coalesce(inner, F.lit(False))
        if isinstance(kind, T.MapType):
            return of(F.map_values(value), T.ArrayType(kind.valueType))
        if isinstance(kind, T.StructType):
            parts = [c for f in kind.fields if (c := of(value[f.name], f.dataType)) is not None]
            return F.coalesce(F.greatest(*parts) if len(parts) > 1 else parts[0], F.lit(False)) if parts else None
        return None

    found = [c for f in df.schema.fields if (c := of(df[f.name], f.dataType)) is not None]
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(False)


def scrubbed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be emitted, and rows in quarantine."""
    marked = events.withColumn("_bad", suspicious(events))
    return marked.where(~F.col("_bad")).drop("_bad"), marked.where("_bad").drop("_bad")


def progress(events: DataFrame) -> DataFrame:
    """By chapter, from chunk events: done, failed, and the seconds they took."""
    chapter = F.regexp_extract("chunk_id", r"^(.*)_[0-9]+$", 1)
    rows = events.where(F.col("event").isin("chunk_done", "chunk_failed")).withColumn("chapter_id", chapter)
    return rows.groupBy("chapter_id").agg(F.count_if(F.col("event") == "chunk_done").alias("done"), F.count_if(F.col("event") == "chunk_failed").alias("failed"), F.sum("latency_s").alias("seconds"))
