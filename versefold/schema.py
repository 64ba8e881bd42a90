"""Schemas and fixed parameters."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()

CHUNK = T.StructType([
    T.StructField("chunk_id", _S), T.StructField("position", _I), T.StructField("text", _S), T.StructField("char_count", _I),
    T.StructField("text_hash", _S), T.StructField("kind", _S), T.StructField("boundary", _S), T.StructField("over_cap", _B),
])
CHAPTERS_FILE = T.ArrayType(T.StructType([T.StructField("chapter_id", _S), T.StructField("number", _S), T.StructField("title", _S), T.StructField("text", _S), T.StructField("chunks", T.ArrayType(CHUNK))]))
MANIFEST_ENTRY = T.StructType([T.StructField("chunk_id", _S), T.StructField("text_hash", _S), T.StructField("wav_path", _S), T.StructField("status", _S), T.StructField("error", _S)])
MANIFEST_FILE = T.StructType([T.StructField("chunks", T.MapType(_S, MANIFEST_ENTRY))])
TAG_REVIEW = T.StructType([T.StructField("chunk_id", _S), T.StructField("text_preview", _S), T.StructField("tag", _S)])
TAG_ITEMS = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField("chunk_id", _S), T.StructField("tag", _S)])))])
#: One row of the event log; each kind uses its own fields.
EVENT = T.StructType([
    T.StructField("event", _S), T.StructField("book", _S), T.StructField("chapters", T.ArrayType(_S)), T.StructField("tagger", _S),
    T.StructField("chapter_id", _S), T.StructField("chunk_count", _L), T.StructField("tagged_count", _L), T.StructField("dropped_count", _L),
    T.StructField("chunk_id", _S), T.StructField("i", _L), T.StructField("n", _L), T.StructField("latency_s", _D), T.StructField("concurrency", _L),
    T.StructField("error", _S), T.StructField("from", _L), T.StructField("to", _L), T.StructField("reason", _S), T.StructField("path", _S),
    T.StructField("duration_s", _D), T.StructField("chapters_done", _L), T.StructField("failed_chunks", _L), T.StructField("message", _S),
])

# Sizes of chunks in characters.
TARGET_CHARS, MAX_CHARS, MIN_CHARS, HARD_SPLIT_CHARS = 200, 300, 60, 600
# Pauses in milliseconds.
CHUNK_GAP_MS, TITLE_GAP_MS, CHAPTER_GAP_MS = 900, 3000, 2000
# The concurrency controller.
START, FLOOR, SAMPLE, FACTOR, STREAK = 3, 1, 5, 1.75, 10
BACKOFF_S, ATTEMPTS, TIMEOUT_S, COURTESY_S = (2.0, 4.0, 8.0), 3, 180.0, 0.3
EVENT_KINDS = ("run_started", "chunked", "tagged", "chunk_done", "chunk_failed", "concurrency_changed", "stitched", "done", "error")
