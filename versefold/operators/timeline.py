"""Timelines: pauses between segments, offsets, durations, lists for a concatenating encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHAPTER_GAP_MS, CHUNK_GAP_MS, TITLE_GAP_MS


def gaps(chunks: DataFrame, chapter: list[str], order: list[str], *, gap_ms: int = CHUNK_GAP_MS, title_gap_ms: int = TITLE_GAP_MS, mid_paragraph_gap_ms: int | None = None) -> DataFrame:
    """chunks with gap_ms, the pause after each: none after a chapter's last, a longer one after a title, an own one after mid-paragraph ends if set."""
    last = F.lead(F.lit(1)).over(Window.partitionBy(*chapter).orderBy(*order)).isNull()
    gap = F.when(last, None).when(F.col("kind") == "title", title_gap_ms)
    if mid_paragraph_gap_ms is not None:
        gap = gap.when(F.col("boundary") == "mid_paragraph", mid_paragraph_gap_ms)
    return chunks.withColumn("gap_ms", gap.otherwise(gap_ms).cast("int"))


def offsets(rows: DataFrame, chapter: list[str], order: list[str], duration: str = "duration_ms") -> DataFrame:
    """rows of gaps() with start_ms within the chapter."""
    before = Window.partitionBy(*chapter).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(duration) + F.coalesce("gap_ms", F.lit(0))).over(before), F.lit(0))
    return rows.withColumn("start_ms", start.cast("long"))


def segments(rows: DataFrame, keep: list[str], order: list[str], path: str, duration: str = "duration_ms") -> DataFrame:
    """A row (*keep, *order, part, segment, path, ms) for each chunk (part 0) and each pause (part 1)."""
    both = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("chunk").alias("segment"), F.col(path).alias("path"), F.col(duration).cast("long").alias("ms")),
        F.when(F.col("gap_ms").isNotNull(), F.struct(F.lit(1).alias("part"), F.lit("gap").alias("segment"), gap_file(F.col("gap_ms")).alias("path"), F.col("gap_ms").cast("long").alias("ms"))),
    )
    return rows.select(*keep, *order, F.inline(F.filter(both, lambda x: x.isNotNull())))


def gap_file(ms: Column) -> Column:
    return F.concat(F.lit("gap_"), ms.cast("string"), F.lit("ms.wav"))


def durations(rows: DataFrame, by: list[str], duration: str = "duration_ms") -> DataFrame:
    """(*by, duration_ms): chunks and the pauses between them."""
    return rows.groupBy(*by).agg(F.sum(F.col(duration) + F.coalesce("gap_ms", F.lit(0))).cast("long").alias("duration_ms"))


def distinct_gaps(rows: DataFrame) -> DataFrame:
    """The pauses that are to be rendered, each once."""
    return rows.where("gap_ms is not null").select("gap_ms").distinct()


def book_timeline(chapters: DataFrame, book: list[str], order: list[str], gap_ms: int = CHAPTER_GAP_MS) -> DataFrame:
    """Chapters (with duration_ms) with gap_ms after each but the last, and start_ms within the book."""
    last = F.lead(F.lit(1)).over(Window.partitionBy(*book).orderBy(*order)).isNull()
    return offsets(chapters.withColumn("gap_ms", F.when(~last, gap_ms)), book, order)


def concat_list(parts: DataFrame, by: list[str], order: list[str], path: str = "path") -> DataFrame:
    """(*by, list): lines file '...' in order, quotes escaped, forward slashes only."""
    quoted = F.replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''"))
    line = F.concat(F.lit("file '"), quoted, F.lit("'"))
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return parts.groupBy(*by).agg(F.concat(F.array_join(F.transform(rows, lambda x: x["_line"]), "\n"), F.lit("\n")).alias("list"))


# What an external encoder is told about sound.
LOUDNESS, ENCODING = "loudnorm=I=-19:TP=-3.0:LRA=11", ("-c:a", "libmp3lame", "-b:a", "128k", "-ar", "44100", "-ac", "1")
JOIN_ARGUMENTS = ("-y", "-f", "concat", "-safe", "0", "-i")
CLIP_SECONDS, CLIP_CLEANING, CLIP_ENCODING = 30.0, "highpass=f=80,afftdn", ("-ar", "44100", "-ac", "1", "-c:a", "pcm_s16le")


def encoder_arguments(list_path: Column, out_path: Column, normalise: bool = False) -> Column:
    """The arguments with which an external encoder joins the segments of a list."""
    after = (["-af", LOUDNESS] if normalise else []) + list(ENCODING)
    return F.array(*[F.lit(w) for w in JOIN_ARGUMENTS], list_path, *[F.lit(w) for w in after], out_path)


def clip_arguments(source: str, target: str, start: float | None = None, duration: float | None = None, clean: bool = False) -> list[str]:
    """The arguments with which an external encoder makes a reference clip: from start, 30 seconds unless told otherwise, mono at 44.1 kHz."""
    seek = [] if start is None else ["-ss", str(start)]
    return ["-y", *seek, "-i", source, "-t", str(CLIP_SECONDS if duration is None else duration), *(["-af", CLIP_CLEANING] if clean else []), *CLIP_ENCODING, target]
