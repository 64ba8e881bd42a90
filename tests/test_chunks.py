import random

import pytest
from pyspark.sql import functions as F

from versefold.operators import chunks as ck
from versefold.operators import packing as pk
from versefold.operators import segments as sg


def units(spark, text):
    rows = sg.split_units(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("unit_id").collect()
    return [r.paragraphs for r in rows]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A.\n\n\nB.", [["A."], ["B."]]), ("A.\n\nB.", [["A.", "B."]]), ("A.\n***\nB.", [["A."], ["B."]]), ("A.\n ---  \nB.", [["A."], ["B."]]), ("A.\n## Heading\nB.", [["A."], ["B."]]),
        ("A.\n————\n\nB.\n \t\nC.", [["A."], ["B.", "C."]]), ("\n\n\nA\n  b \nc\n\n\n\n", [["A b c"]]), ("#no\nA\n**\n-- -", [["#no A ** -- -"]]), ("", []), ("\n \n", []), ("A\r\n\r\n\r\nB", [["A"], ["B"]]),
    ],
)
def test_units(spark, text, want):
    assert units(spark, text) == want


def test_chapters(spark):
    book = "Front\n\nChapter 1: The Start\nOne.\n  chapter 2.5 — Half \nTwo.\u2028CHAPTER 3\nThree\nChapter 4 was long.\nChapters 5\nAChapter 6\n"
    rows = sg.split_chapters(spark.createDataFrame([(1, book), (2, "None"), (3, "Chapter 9"), (4, None)], "id int, text string")).orderBy("id", "ordinal").collect()
    assert [(r.id, r.chapter_id, r.number, r.title, r.text) for r in rows] == [
        (1, "ch00", None, "", "Front\n\n"), (1, "ch01", "1", "The Start", "One.\n"), (1, "ch02_5", "2.5", "Half", "Two.\u2028"), (1, "ch03", "3", "", "Three\n"), (1, "ch04", "4", "was long.", "Chapters 5\nAChapter 6\n"),
        (2, "ch00", None, "", "None"), (3, "ch00", None, "", ""), (3, "ch09", "9", "", ""), (4, "ch00", None, "", ""),
    ]


def piece(n, boundary="mid_paragraph", kind="body", mark="x"):
    return (mark * n, n > 300, boundary, kind)


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([piece(150), piece(20), piece(25), piece(20), piece(150, "ends_section")], [150, 67, 150]),
        ([piece(200), piece(30, "ends_section"), piece(40)], [231, 40]),
        ([piece(280), piece(30), piece(280)], [280, 30, 280]),
        ([piece(20, "ends_section"), piece(20)], [20, 20]),
        ([piece(30, "ends_section"), piece(350)], [30, 350]),
        ([piece(10, "ends_section", "title"), piece(20)], [10, 20]),
        ([piece(30, kind="title"), piece(20), piece(30)], [30, 51]),
        ([], []),
    ],
)
def test_merge_table(items, want):
    assert [len(p[0]) for p in pk.merged(items, 60, 300)] == want


def fixed_point(items, least, cap):
    """The rule as it is stated: merge the first small item that can be, and start again."""
    out = list(items)
    while True:
        for i, x in enumerate(out):
            if x[3] == "title" or len(x[0]) >= least:
                continue
            near = []
            for at, other in ((i - 1, i - 1), (i, i + 1)):
                if 0 <= at and other < len(out) and at + 1 < len(out) and out[other][3] != "title" and out[at][2] != "ends_section" and len(out[at][0]) + 1 + len(out[at + 1][0]) <= cap:
                    near.append((len(out[other][0]), at))
            if near:
                at = min(near)[1]
                text = out[at][0] + " " + out[at + 1][0]
                out[at : at + 2] = [(text, len(text) > cap, out[at + 1][2], "body")]
                break
        else:
            return out


def test_merge_is_the_fixed_point():
    rng = random.Random(3)
    for _ in range(20_000):
        cap, least = rng.choice([20, 30, 60]), rng.choice([3, 6, 12, 25])
        items = [piece(rng.randint(1, cap + 5), rng.choice(["mid_paragraph", "ends_paragraph", "ends_section"]), rng.choice(["body"] * 9 + ["title"]), chr(97 + k)) for k in range(rng.randint(0, 9))]
        items = [(t, len(t) > cap, b, k) for t, _, b, k in items]
        assert list(pk.merged(items, least, cap)) == fixed_point(items, least, cap)


def test_packing():
    assert list(pk.packed(["a" * 150, "b" * 60, "c"], 200, 300)) == ["a" * 150 + " " + "b" * 60, "c"]
    assert list(pk.packed(["a" * 150, "b" * 160, "c"], 200, 300)) == ["a" * 150, "b" * 160 + " c"]
    assert list(pk.packed(["a" * 400], 200, 300)) == ["a" * 400]
    assert list(pk.packed_paragraphs([["a" * 10], ["b" * 55]], 200, 300, 60, 600)) == [("a" * 10 + " " + "b" * 55, "ends_paragraph")]
    assert list(pk.packed_paragraphs([["a" * 210]], 200, 300, 60, 600)) == [("a" * 210, "ends_paragraph")]
    assert list(pk.packed_paragraphs([["a" * 210, "b" * 10]], 200, 300, 60, 600)) == [("a" * 210, "mid_paragraph"), ("b" * 10, "ends_paragraph")]


def test_book_properties(spark, sf_dir):
    from versefold.plans import catalog

    books = catalog.books(spark, sf_dir).limit(40).persist()
    chunks = ck.book_chunks(books, "text", ["book_id"]).persist()
    assert chunks.where("char_count > 300 and not over_cap").count() == 0
    assert chunks.where("kind = 'title' and position <> 0").count() == 0
    said = {r.book_id: r.t for r in chunks.where("kind = 'body'").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "position", "text"))).alias("t")).collect()}
    for r in books.collect():
        lines = [x for x in r.text.split("\n") if not x.strip().lower().startswith("chapter ") and x != "***"]
        assert "".join("".join(x.text for x in said.get(r.book_id, [])).split()) == "".join("".join(lines).split())
    per = chunks.groupBy("book_id", "ordinal").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in per)


def test_dialogue_stays_together(spark):
    text = "\n\n".join(f'"Line {k}," she said.' for k in range(6))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = ck.build_chunks(df, "text", ["id"], F.lit("ch00")).collect()
    assert len(got) < 6 and got[-1].boundary == "ends_section"
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.position)] == [f"ch00_{k:04d}" for k in range(len(got))]
