"""Text expressions: stripping, sentences, hashes, names. All but the walk over a WAV file are built-in functions, so they stay in generated code."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Unicode has them for stripping; and those that don't end a line.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INLINE = r"\t\x0b-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Noncharacters that mark places while a text is taken apart; they are replaced in input.
GUARD, CUT, PART, FIELD = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

# Tokens whose full stop ends no sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Rev", "Fr", "Sr", "Jr", "St", "Lt", "Capt", "Col", "Gen", "Sgt", "Maj", "Adm", "Gov", "Sen", "Rep", "Hon", "Messrs", "Mmes",
    "vs", "etc", "e.g", "i.e", "cf", "al", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun",
)
# What may close a sentence after its mark, and what may open the next.
CLOSERS, OPENERS = "\"'”’)", "\"'“‘("
_CLOSE, _OPEN = rf"[{CLOSERS}\]]", rf"{OPENERS}\["
_UPPER = r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}"


#: All blanks as one string, for trimming without a regular expression.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def clean(text: Column) -> Column:
    """A text without the marking noncharacters, lines ending in \\n; null is empty."""
    text = F.coalesce(text, F.lit(""))
    marks = GUARD + CUT + PART + FIELD
    text = F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "\ufffd" * 4)).otherwise(text)
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _branches(words: tuple[str, ...]) -> str:
    """An expression for any of the words that looks at each letter once; no word is tried after one that it begins with."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ways = [re.escape(c) + _branches(tuple(rest)) for c, rest in heads.items() if c]
    if "" in heads:
        ways.append("")
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def sentences(text: Column) -> Column:
    """A text's sentences. A run of .!? and closers ends one where blanks and a capital or opener follow, or nothing does, unless an abbreviation stands before it.

    Abbreviations get a mark that keeps the second pass from cutting after them. That pass takes the blanks along, so
    only the whole text is stripped.
    """
    first = "".join(sorted({a[0] for a in ABBREVIATIONS}))
    known = rf"(?=[{first}]){_branches(ABBREVIATIONS)}(?=[{BLANK}]*+[.!?])(?<=(?:^|[{BLANK}])[{_OPEN}]{{0,32}}+{_branches(ABBREVIATIONS)})[{BLANK}]*+[.!?]++{_CLOSE}*+"
    guarded = F.regexp_replace(strip(text), known, f"$0{GUARD}")
    cut = F.regexp_replace(guarded, rf"([.!?]++{_CLOSE}*+)[{BLANK}]++(?=[{_UPPER}{_OPEN}])", f"$1{CUT}")
    return F.filter(F.split(F.replace(cut, F.lit(GUARD), F.lit("")), CUT, -1), lambda s: s != "")


def split_long(sentence: Column, limit: int = 600) -> Column:
    """A sentence as one or two pieces: one over the limit is cut after the ,;: nearest its middle (the first of two), unless a side would be empty."""
    n = F.length(sentence)
    marks = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(sentence, i, F.lit(1)).isin(",", ";", ":"))
    at = F.array_min(F.transform(marks, lambda i: F.struct(F.abs(i - 1 - n / 2).alias("d"), i.alias("i"))))["i"]
    head, tail = strip(F.substring(sentence, F.lit(1), at)), strip(F.substring(sentence, at + 1, n))
    return F.when((n > limit) & at.isNotNull(), F.when((head != "") & (tail != ""), F.array(head, tail)).otherwise(F.array(sentence))).otherwise(F.array(sentence))


def tagged(text: Column, tag: Column) -> Column:
    """The text with its tag in brackets before it, or the text where there is none."""
    return F.when(F.coalesce(tag, F.lit("")) != "", F.concat(F.lit("["), tag, F.lit("] "), text)).otherwise(text)


def text_hash(text: Column, tag: Column | None = None) -> Column:
    return F.sha2((text if tag is None else tagged(text, tag)).cast("binary"), 256)


def speakable(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9]")


def words(text: Column) -> Column:
    """The distinct runs of a-z of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def slug(stem: Column) -> Column:
    """A file's stem as a folder name."""
    name = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("book"))


def safe_name(value: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+\z", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("untitled"))


def chapter_path(book: Column, number: Column, title: Column) -> Column:
    return F.concat(safe_name(book), F.lit("/Chapter "), F.format_string("%02d", number), F.lit(" - "), safe_name(title), F.lit(".mp3"))


def preview(text: Column, n: int = 60) -> Column:
    return F.substring(text, 1, n)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, "[A-Za-z0-9_-]{20,}", "<redacted>")


def key_shaped(text: Column) -> Column:
    """Whether a value holds a run that looks like a key."""
    return F.coalesce(text.rlike("[A-Za-z0-9_-]{20}"), F.lit(False))


def compact(text: Column, most: int = 500) -> Column:
    """A diagnostic on one line, cut with dots."""
    one = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"[{BLANK}]+", " ")
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("..."))).otherwise(one)


def error_class(message: Column) -> Column:
    """rate_limit, server or other, by the status code in parentheses."""
    code = F.regexp_extract(message, r"\(([45][0-9][0-9])\)", 1)
    return F.when(code == "429", "rate_limit").when(code.startswith("5"), "server").otherwise("other")


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """The wait after a failed attempt (from 0): what the answer asks for, else 2, 4, 8."""
    schedule = F.array(F.lit(2.0), F.lit(4.0), F.lit(8.0))
    return F.coalesce(retry_after.cast("double"), F.element_at(schedule, F.least(attempt, F.lit(2)).cast("int") + 1))


def timeout_seconds(raw: Column, default: float = 180.0) -> Column:
    """A timeout setting clamped to 5 to 3600 seconds; the default where it is absent or no number."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(5.0), F.least(value, F.lit(3600.0)))).otherwise(default)


def retry_after(header: Column) -> Column:
    return header.try_cast("double")


def silent_wav(duration_ms: Column, rate: int = 44100, channels: int = 1, extra: bytes = b"") -> Column:
    """The bytes of a 16-bit PCM WAV file of silence, with further chunks before the data if given."""

    def little(n: Column, size: int) -> Column:
        digits = F.lpad(F.hex(n), 2 * size, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]))

    frame = 2 * channels
    size = (F.floor(F.lit(rate) * duration_ms / 1000.0) * frame).cast("long")
    raw = lambda s: F.lit(s).cast("binary")
    fmt = struct.pack("<IHHIIHH", 16, 1, channels, rate, frame * rate, frame, 16) + extra
    return F.concat(raw("RIFF"), little(size + 36 + len(extra), 4), raw("WAVEfmt "), F.lit(fmt), raw("data"), little(size, 4), F.unhex(F.repeat(F.lit("00"), size.cast("int"))))


def wav_fields(data: bytes | None) -> dict:
    """What a WAV file says of itself, from a walk over its chunks: seconds, sample_rate, channels, sample_format; nulls for what isn't there."""
    out = {"seconds": None, "sample_rate": None, "channels": None, "sample_format": None}
    if data is None or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return out
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(data):
            code, channels, sample_rate, rate, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if code == 0xFFFE and size >= 40 and at + 34 <= len(data):
                code = int.from_bytes(data[at + 32 : at + 34], "little")
            sample = {(1, 8): "u8", (1, 16): "s16", (1, 24): "s24", (1, 32): "s32", (3, 32): "flt", (3, 64): "dbl"}.get((code, bits))
            out |= {"sample_rate": sample_rate, "channels": channels, "sample_format": sample}
        elif name == b"data":
            if rate:
                out["seconds"] = min(size, len(data) - at - 8) / rate
            break
        at += 8 + size + size % 2
    return out


def wav_info(wav: Column) -> Column:
    """wav_fields as a struct. The walk's steps depend on sizes in the file, so it runs over Arrow batches."""

    @F.pandas_udf("seconds double, sample_rate int, channels int, sample_format string")
    def read(files: pd.Series) -> pd.DataFrame:
        rows = [wav_fields(None if f is None else bytes(f)) for f in files]
        return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=kind) for k, kind in (("seconds", "float64"), ("sample_rate", "Int32"), ("channels", "Int32"), ("sample_format", "object"))})

    return read(wav)


def wav_seconds(wav: Column) -> Column:
    """The playing time of a PCM WAV file."""
    return wav_info(wav)["seconds"]
