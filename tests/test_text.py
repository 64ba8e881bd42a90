import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from versefold.functions import chapters as ch
from versefold.functions import tags as tg
from versefold.functions import text as tx
from versefold.operators.packing import cut_long


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def walked(text):
    """Sentences by a plain walk over the characters."""
    out, start, i = [], 0, 0
    text = text.strip()
    while i < len(text):
        if text[i] not in ".!?":
            i += 1
            continue
        mark = i
        while i < len(text) and text[i] in ".!?":
            i += 1
        while i < len(text) and text[i] in tx.CLOSERS + "]":
            i += 1
        after = i
        while after < len(text) and text[after].isspace():
            after += 1
        before = text[start:mark].rstrip().split()
        known = bool(before) and before[-1].lstrip(tx.OPENERS + "[") in tx.ABBREVIATIONS
        if i < after < len(text) and not known and (text[after].isupper() or text[after] in tx.OPENERS + "["):
            out.append(text[start:i])
            start = i = after
    return [*out, text[start:]] if text[start:] else out


def test_whole_documents_by_a_walk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", tx.sentences(tx.clean(F.col("text"))).alias("s")).collect()
    assert all(r.s == walked((r.text or "").replace("\r\n", "\n").replace("\r", "\n")) for r in rows)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Rainfall reached 2.75 inches on the ridge that week.", 1), ("Nobody at the U.N. office had read the letter.", 1), ('"Wait!" he shouted.', 1),
        ("Prof. Lindqvist waved.", 1), ("Messrs. Okafor and Dr. Ito sat down.", 1), ("They sailed to St. Helena. The wind dropped.", 2), ("Pack rope, nails, etc. Then lock the shed.", 1),
        ("She came in 3rd. Then everybody clapped.", 2), ("They heard it fall. Then it rained.", 2), ("(Mr. Vey) left. “Gov. Ames” stayed.", 2), ("xMr. Vey left.", 2), ("Sept. Nine was hot. Mon. Ten wasn't", 2), ("", 0), ("  \n ", 0), ("No mark", 1), ("One.\u00a0Two.\nThree?!” “Four.", 4), ("A.\x1cB.", 2),
    ],
)
def test_sentences(spark, text, n):
    (got,) = column(spark, [text], lambda c: tx.sentences(tx.clean(c)))
    assert len(got) == n
    assert got == walked(text)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_marks_in_input_are_replaced(spark):
    assert column(spark, ["a\ufdd1b\r\nc\rd", None], tx.clean) == ["a\ufffdb\nc\nd", ""]


def test_long_sentences(spark):
    long = "x" * 350 + ", " + "y" * 300
    tie = "a" * 300 + "," + "b" * 0 + "," + "c" * 300
    cases = ["short, one", long, "z" * 700, "," + "q" * 700, tie, "w" * 700 + ","]
    got = column(spark, cases, tx.split_long)
    assert got == [cut_long(c, 600) for c in cases]
    assert got[1] == ["x" * 350 + ",", "y" * 300]
    assert [len(x) for x in got] == [1, 2, 1, 2, 2, 1]


def test_hash_and_tag(spark):
    df = spark.createDataFrame([("Hello.", "weary"), ("Hello.", ""), ("Hello.", None)], "t string, g string")
    got = [(r.a, r.h) for r in df.select(tx.tagged(F.col("t"), F.col("g")).alias("a"), tx.text_hash(F.col("t"), F.col("g")).alias("h")).collect()]
    want = ["[weary] Hello.", "Hello.", "Hello."]
    assert got == [(w, hashlib.sha256(w.encode()).hexdigest()) for w in want]


def test_speakable_and_names(spark):
    assert column(spark, [".", "***", "   ", "—", "A", "7", "a.", "é"], tx.speakable) == [False] * 4 + [True] * 3 + [False]
    assert column(spark, ["My Book!", "..", "", "a_b.c"], tx.slug) == ["My_Book", "book", "book", "a_b.c"]
    assert column(spark, ['a<b>:"c"', " . ", "x\x01y", "ok."], tx.safe_name) == ["a_b___c_", "untitled", "x_y", "ok"]
    assert column(spark, ["failed (429)", "x (503) y", "(404)", "500"], tx.error_class) == ["rate_limit", "server", "other", "other"]
    assert column(spark, ["1", "17.5", "99999", "nope", None], tx.timeout_seconds) == [5.0, 17.5, 3600.0, 180.0, 180.0]
    assert column(spark, ["k " + "A1_-" * 5 + "x y"], tx.redact) == ["k <redacted> y"]
    assert column(spark, [" a \n\t b ", "x" * 600, None], tx.compact) == ["a b", "x" * 500 + "...", ""]


def test_silent_wav(spark):
    (wav,) = column(spark, [200], lambda c: tx.silent_wav(c), "int")
    assert bytes(wav[:44]) == b"RIFF" + struct.pack("<I", 36 + 17640) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44100, 88200, 2, 16) + b"data" + struct.pack("<I", 17640)
    assert len(wav) == 44 + 17640 and not any(wav[44:])
    df = spark.createDataFrame([(bytes(wav),)], "v binary")
    assert abs(df.select(tx.wav_seconds(F.col("v"))).first()[0] - 0.2) < 1e-9


def test_wav_walk():
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    fmt = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 22050, 88200, 4, 16))
    wide = chunk(b"fmt ", struct.pack("<HHIIHH", 0xFFFE, 1, 48000, 192000, 4, 32) + struct.pack("<HHI", 22, 32, 4) + struct.pack("<H", 3) + bytes(14))
    file = lambda *parts: b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WAVE" + b"".join(parts)
    assert tx.wav_fields(file(chunk(b"LIST", b"abc"), fmt, chunk(b"data", bytes(88200)))) == {"seconds": 1.0, "sample_rate": 22050, "channels": 2, "sample_format": "s16"}
    assert tx.wav_fields(file(wide, chunk(b"data", bytes(96000)))) == {"seconds": 0.5, "sample_rate": 48000, "channels": 1, "sample_format": "flt"}
    nothing = dict.fromkeys(("seconds", "sample_rate", "channels", "sample_format"))
    assert [tx.wav_fields(x) for x in (None, b"", b"RIFFxxxx", b"ID3" * 9)] == [nothing] * 4
    whole = file(fmt, chunk(b"data", bytes(400)))
    for n in range(len(whole)):
        tx.wav_fields(whole[:n])
    assert tx.wav_fields(whole[:-100])["seconds"] == 300 / 88200


def test_chapters(spark):
    assert column(spark, ["0", "1", "02", "7.5", "120"], ch.chapter_id) == ["ch00", "ch01", "ch02", "ch07_5", "ch120"]
    said = {0: "", 1: "one", 7: "seven", 10: "ten", 13: "thirteen", 20: "twenty", 21: "twenty-one", 42: "forty-two", 99: "ninety-nine", 100: "one hundred", 101: "one hundred one", 115: "one hundred fifteen", 1000: "1000", -3: "minus three"}
    assert column(spark, list(said), lambda c: ch.int_to_words(c), "long") == list(said.values())
    assert column(spark, ["7.5", "7.05", "21"], ch.chapter_number_words) == ["seven point five", "seven point five", "twenty-one"]
    assert column(spark, ["0"], lambda c: ch.chapter_number_words(c, "zero")) == ["zero"]
    assert column(spark, ["21", "3"], lambda c: ch.chapter_title(c, F.lit(" The End? "))) == ["Chapter Twenty-One. The End?", "Chapter Three. The End?"]
    assert column(spark, ["0"], lambda c: ch.chapter_title(c, F.lit(""))) == ["Chapter ."]


def test_selection(spark):
    ids = ["ch00", "ch01", "ch02", "ch07_5", "ch12"]
    pick = lambda s: [i for i, r in zip(ids, column(spark, ids, lambda c: ch.selected(c, s)), strict=True) if r]
    assert pick(None) == ids
    assert pick("CH01, ch12") == ["ch01", "ch12"]
    assert pick("1-7") == ["ch01", "ch02", "ch07_5"]
    assert pick("ch02-ch12") == ["ch02", "ch07_5", "ch12"]
    assert pick("7") == ["ch07_5"]
    assert pick("x-y") == []


def test_tag_rules(spark):
    cases = [
        ("weary", "", None), ("", "", "empty tag"), (None, "", "empty tag"), ("a" * 33, "", "tag exceeds 32 chars (len=33)"), ("a" * 32, "", "tag not in shipped vocabulary"),
        *[(t, "", "tag does not match ^[a-z][a-z ,-]*$") for t in ("Weary", "weary2", "[weary]", "weary.", "weary!", "WEARY", "weary_sad")],
        ("storm harbor", "The storm took the harbor.", "tag echoes chunk text word(s): harbor, storm"), ("quietly amused", "x", "tag not in shipped vocabulary"), ("bitter amusement", "The a of", None), ("weary\n", "", "tag does not match ^[a-z][a-z ,-]*$"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.r for r in df.select("i", tg.rejection(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    # A last line break passes the shape, as $ stands before it, and fails the vocabulary.
    assert got[:-1] == [c[2] for c in cases[:-1]]
    assert got[-1] is not None
    assert all(column(spark, list(tg.VOCABULARY), lambda c: tg.rejection(c, F.lit("")).isNull()))
