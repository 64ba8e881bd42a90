import pytest
from pyspark.sql import functions as F

from versefold import cli
from versefold.operators import tagging as ta
from versefold.operators import timeline as tl

BOOK = "Before it all.\n\nChapter 1: Dawn\nIt was early! He ran.\n\n***\n\nWho was there? Nobody at all answered him for a long time.\nChapter 2\nThe end.\n"


def test_run_and_resume(spark, tmp_path):
    (tmp_path / "My Book.txt").write_text(BOOK)
    out = str(tmp_path / "out")
    (tmp_path / "c.json").write_text('{"calls": {"courtesy_delay_s": 0}}')
    args = ["--book", str(tmp_path / "My Book.txt"), "--out", out, "--tagger", "by-mark", "--config", str(tmp_path / "c.json")]
    assert cli.main(["run", *args, "--single-file"], spark) == 0
    table = lambda n: spark.read.parquet(f"{out}/{n}")
    chunks = table("chunks").orderBy("ordinal", "position").collect()
    assert [c.chunk_id for c in chunks] == ["ch00_0000", "ch01_0000", "ch01_0001", "ch01_0002", "ch02_0000", "ch02_0001"]
    assert table("manifest").where("status = 'done'").count() == 6 == table("audio").count()
    assert table("timeline").where("gap_ms is null").count() == 3
    assert table("book_timeline").count() == 3
    lines = table("lists").where("ordinal = 1").first().list.splitlines()
    assert lines[:2] == ["file 'My_Book/ch01_0000.wav'", "file 'gap_3000ms.wav'"] and len(lines) == 5
    assert table("outputs").where("ordinal = 1").first().path == "My_Book/Chapter 01 - Dawn.mp3"
    kinds = {r["event"]: r["n"] for r in spark.read.json(f"{out}/events").groupBy("event").agg(F.count("*").alias("n")).collect()}
    kinds.pop("concurrency_changed", None)  # calls of some microseconds differ by more than the controller allows
    assert kinds == {"run_started": 1, "chunked": 3, "tagged": 3, "chunk_done": 6, "stitched": 3, "done": 1}
    assert cli.main(["generate", "--out", out], spark) == 0
    assert table("audio.new").count() == 0
    skipped = spark.read.json(f"{out}/events").where("event = 'chunk_done' and latency_s = 0 and concurrency = 3")
    assert skipped.count() == 6 and {(r.chunk_id, r.n) for r in skipped.where("chunk_id like 'ch01%'").collect()} == {(f"ch01_000{k}", 3) for k in range(3)}
    (tmp_path / "My Book.txt").write_text(BOOK.replace("The end.", "The other end."))
    cli.main(["chunk", *args], spark)
    cli.main(["generate", "--out", out, "--chapters", "1"], spark)
    assert table("audio.new").count() == 0
    cli.main(["generate", "--out", out, "--chapters", "ch02"], spark)
    assert [r.chunk_id for r in table("audio.new").collect()] == ["ch02_0001"]
    assert table("manifest").count() == 6
    cli.main(["stitch", "--out", out], spark)
    assert table("inputs").count() == 6 and table("inputs").where("missing").count() == 0
    # An edited chunk has no audio until it is made again; the old audio of other words is not used for it; ch02 has its first words, and so its first audio, again.
    (tmp_path / "My Book.txt").write_text(BOOK.replace("It was early!", "It was late!"))
    cli.main(["chunk", *args], spark)
    cli.main(["stitch", "--out", out], spark)
    assert {r.chunk_id for r in table("inputs").where("missing").collect()} == {"ch01_0001"}
    assert table("timeline").count() == 5


def test_clip(capsys):
    assert cli.main(["clip", "a.mp3", "b.wav", "--start", "2.5", "--clean"]) == 0
    assert capsys.readouterr().out.split() == ["-y", "-ss", "2.5", "-i", "a.mp3", "-t", "30.0", "-af", "highpass=f=80,afftdn", "-ar", "44100", "-ac", "1", "-c:a", "pcm_s16le", "b.wav"]


def test_encoder_arguments_and_backends(spark):
    (row,) = spark.range(1).select(tl.encoder_arguments(F.lit("l"), F.lit("o"), True).alias("a")).collect()
    assert row.a[:7] == ["-y", "-f", "concat", "-safe", "0", "-i", "l"] and row.a[-1] == "o" and "-af" in row.a
    assert ta.get_backend("auto")([{"chunk_id": "1", "text": "x!"}]) == {}
    with pytest.raises(KeyError, match="no tag backend"):
        ta.get_backend("cloud")
    rows = ['{"output_text":"a"}', '{"output_text":"","output":[{"content":null},{"content":[{"text":""},{"text":"b"}]}]}', "{}", "oops", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    assert [r.t for r in df.select("i", ta.response_text(F.col("p")).alias("t")).orderBy("i").collect()] == ["a", "b", None, None, None]
