"""Books to chapters, chapters to packable units and paragraphs. Each text is taken apart within its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chapters import chapter_id
from ..functions.text import CUT, FIELD, INLINE, PART, clean, sentences, strip

#: What ends a line where chapters are looked for: more than \n.
_ENDS = r"\n-\r\x1c-\x1e\x85\x{2028}\x{2029}"
_WITHIN = r"\t\x1f\x20\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_HEADING = (
    rf"(?<![^{_ENDS}])[{_WITHIN}]*+(?i:chapter)[{_WITHIN}]++([0-9]++(?:\.[0-9]++)?)[{_WITHIN}]*+[:\-–—]?[{_WITHIN}]*+([^{_ENDS}]*+)(?:\r\n|[{_ENDS}]|\z)"
)


def split_chapters(books: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row (*keep, ordinal, chapter_id, number, title, text) for each chapter.

    A line `Chapter N`, with a separator and a title or without, begins one; the heading isn't in its text. What comes
    first is front matter, ch00, even where it is empty. Ordinals count within the book, as chapter ids may repeat.
    """
    keep = keep if keep is not None else [c for c in books.columns if c != text]
    marked = F.regexp_replace(clean(F.col(text)), _HEADING, f"{PART}$1{FIELD}$2{FIELD}")
    parts = books.select(*keep, F.posexplode(F.split(marked, PART, -1)).alias("ordinal", "_p"))
    field = lambda k: F.get(F.split("_p", FIELD, 3), F.lit(k))
    heading = F.col("ordinal") > 0
    number = F.when(heading, field(0))
    return parts.select(
        *keep, "ordinal", F.when(heading, chapter_id(number)).otherwise("ch00").alias("chapter_id"), number.alias("number"),
        F.when(heading, strip(field(1))).otherwise(F.lit("")).alias("title"), F.when(heading, field(2)).otherwise(F.col("_p")).alias("text"),
    )


def _units(text: Column) -> Column:
    """The text with CUT between units and FIELD between paragraphs."""
    marker = rf"(?md)^[{INLINE}]*+[*\-—]{{3,}}+[{INLINE}]*+$"
    heading = rf"(?md)^[{INLINE}]*+#{{1,6}}[{INLINE}].*$"
    text = F.regexp_replace(F.regexp_replace(text, marker, CUT), heading, CUT)
    text = F.regexp_replace(text, rf"\n(?:[{INLINE}]*+\n){{2,}}+", f"\n{CUT}\n")
    return F.regexp_replace(text, rf"\n(?:[{INLINE}]*+\n)++", f"\n{FIELD}\n")


def paragraphs(unit: Column) -> Column:
    """A unit's paragraphs, each its stripped lines joined by one blank."""
    lines = lambda p: F.filter(F.transform(F.split(p, "\n", -1), strip), lambda x: x != "")
    return F.filter(F.transform(F.split(unit, FIELD, -1), lambda p: F.array_join(lines(p), " ")), lambda p: p != "")


def split_units(chapters: DataFrame, text: str = "text", keep: list[str] | None = None, normalised: bool = False, title: Column | None = None) -> DataFrame:
    """A row (*keep, unit_id, paragraphs) for each packable unit.

    Units end at lines of *, - or em dashes only, at Markdown headings, and at two blank lines or more; such lines are
    in no paragraph. One blank line ends a paragraph. Units without paragraphs are left out. A title, where it isn't
    null, is a unit of one paragraph before them, with the id -1.
    """
    keep = keep if keep is not None else [c for c in chapters.columns if c != text]
    own = F.col(text) if normalised else clean(F.col(text))
    parts = F.transform(F.split(_units(own), CUT, -1), lambda u, i: F.struct(i.alias("unit_id"), u.alias("_u")))
    if title is not None:
        head = F.filter(F.array(F.struct(F.lit(-1).alias("unit_id"), title.alias("_u"))), lambda x: x["_u"].isNotNull())
        parts = F.concat(head, parts)
    units = chapters.select(*keep, F.inline(parts))
    whole = F.when(F.col("unit_id") < 0, F.array("_u")).otherwise(paragraphs(F.col("_u"))) if title is not None else paragraphs(F.col("_u"))
    return units.select(*keep, "unit_id", whole.alias("paragraphs")).where(F.size("paragraphs") > 0)


def split_unit_sentences(units: DataFrame) -> DataFrame:
    """The units with `sentences`, an array of each paragraph's sentences; a title stays whole."""
    return units.withColumn("sentences", F.when(F.col("unit_id") < 0, F.transform("paragraphs", lambda p: F.array(p))).otherwise(F.transform("paragraphs", sentences)) if "unit_id" in units.columns else F.transform("paragraphs", sentences)).drop("paragraphs")
