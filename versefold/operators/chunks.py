"""Chunks: the primary table, from books or texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chapters import chapter_title
from ..functions.text import text_hash
from .packing import pack_units
from .segments import split_chapters, split_unit_sentences, split_units


def chunk_id(chapter_id: Column, position: Column) -> Column:
    return F.concat(chapter_id, F.lit("_"), F.format_string("%04d", position))


def _chunks(texts: DataFrame, text: str, keep: list[str], chapter: Column, title: Column | None, sizes: dict[str, int]) -> DataFrame:
    units = split_unit_sentences(split_units(texts, text, keep, title=title))
    pieces = pack_units(units, "sentences", [*keep, "unit_id"], title="unit_id", **sizes)
    position = F.row_number().over(Window.partitionBy(*keep).orderBy("unit_id", "idx")) - 1
    rows = pieces.withColumn("position", position.cast("int"))
    return rows.select(
        *keep, chunk_id(chapter, F.col("position")).alias("chunk_id"), "position", "text", F.length("text").alias("char_count"),
        text_hash(F.col("text")).alias("text_hash"), "kind", "boundary", "over_cap",
    )


def build_chunks(texts: DataFrame, text: str, keep: list[str], chapter: Column, **sizes: int) -> DataFrame:
    """Chunk records of texts that are chapters; keep identifies a text. Positions count from 0 within it. sizes: target, cap, least, limit."""
    return _chunks(texts, text, keep, chapter, None, sizes)


def book_chunks(books: DataFrame, text: str, keep: list[str], zero: str = "", **sizes: int) -> DataFrame:
    """Chunk records of books, with ordinal: each chapter's title chunk at position 0, then its bodies; front matter has no title and starts at 0.

    Titles and bodies come of one pass over the books.
    """
    chapters = split_chapters(books, text, keep)
    ids = [*keep, "ordinal", "chapter_id", "number"]
    title = F.when(F.col("number").isNotNull(), chapter_title(F.col("number"), F.col("title"), zero))
    return _chunks(chapters, "text", ids, F.col("chapter_id"), title, sizes)


def chunk_counts(chapters: DataFrame, chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, chunk_count) of all chapters, 0 for those without chunks."""
    counts = chunks.groupBy(*keep).agg(F.count("*").alias("chunk_count"))
    return chapters.select(*keep).join(counts, keep, "left").select(*keep, F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
