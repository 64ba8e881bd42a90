"""Chapter numbers: ids, words, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Number words.
ONES = ("", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def _parts(number: Column) -> tuple[Column, Column]:
    """The whole part and the digits after the point (empty without one)."""
    return F.substring_index(number, ".", 1), F.when(F.instr(number, ".") > 0, F.substring_index(number, ".", -1)).otherwise(F.lit(""))


def chapter_id(number: Column) -> Column:
    """ch07 for 7, ch07_5 for 7.5; the digits after the point stay as they are."""
    whole, after = _parts(number)
    plain = F.regexp_replace(whole, "^0+(?=[0-9])", "")
    padded = F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain)
    return F.concat(F.lit("ch"), padded, F.when(after != "", F.concat(F.lit("_"), after)).otherwise(F.lit("")))


def _pick(table: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in table]), (n + 1).cast("int"))


def _below_hundred(n: Column) -> Column:
    rest = n % 10
    return F.when(n < 20, _pick(ONES, F.least(n, F.lit(19)))).otherwise(F.concat(_pick(TENS, (n / 10).cast("int") % 10), F.when(rest > 0, F.concat(F.lit("-"), _pick(ONES, rest))).otherwise(F.lit(""))))


def int_to_words(n: Column, zero: str = "") -> Column:
    """0 to 999 in words ("one hundred one"; `zero` for 0), larger numbers in digits, "minus" before what is below 0."""
    size = F.abs(n).cast("long")
    rest = size % 100
    hundreds = F.concat(_pick(ONES, (size / 100).cast("int") % 10), F.lit(" hundred"), F.when(rest > 0, F.concat(F.lit(" "), _below_hundred(rest))).otherwise(F.lit("")))
    said = F.when(size == 0, F.lit(zero)).when(size < 100, _below_hundred(rest)).when(size < 1000, hundreds).otherwise(size.cast("string"))
    return F.when(n < 0, F.concat(F.lit("minus "), said)).otherwise(said)


def chapter_number_words(number: Column, zero: str = "") -> Column:
    """7.5 as "seven point five"."""
    whole, after = _parts(number)
    said = int_to_words(whole.cast("long"), zero)
    return F.when(after != "", F.concat(said, F.lit(" point "), int_to_words(after.try_cast("long"), zero))).otherwise(said)


def title_case(words: Column) -> Column:
    """Each run of letters with a capital: Twenty-One."""
    return F.replace(F.initcap(F.replace(words, F.lit("-"), F.lit(" - "))), F.lit(" - "), F.lit("-"))


def chapter_title(number: Column, subtitle: Column, zero: str = "") -> Column:
    """What is spoken for a heading: Chapter Seven. Subtitle."""
    rest = strip(F.coalesce(subtitle, F.lit("")))
    ended = F.when(F.substring(rest, -1, 1).isin(".", "!", "?"), rest).otherwise(F.concat(rest, F.lit(".")))
    return F.concat(F.lit("Chapter "), title_case(chapter_number_words(number, zero)), F.lit("."), F.when(rest != "", F.concat(F.lit(" "), ended)).otherwise(F.lit("")))


def selected(chapter_id: Column, selection: str | None) -> Column:
    """Whether a chapter is in a selection: ids with commas between (ch01,ch03), or one number or range (3, 1-3, ch01-ch03), which goes by the whole part."""
    import re

    if not selection:
        return F.lit(True)
    listed = F.lower(chapter_id).isin([x.strip().lower() for x in selection.split(",") if x.strip()])
    span = re.fullmatch(r"(?:ch)?(\d+)(?:-(?:ch)?(\d+))?", selection.strip(), re.IGNORECASE)
    if not span:
        return listed
    low, high = int(span[1]), int(span[2] or span[1])
    whole = F.regexp_extract(F.lower(chapter_id), "^ch([0-9]+)(?:_.*)?$", 1).try_cast("long")
    return listed | F.coalesce(whole.between(low, high), F.lit(False))
