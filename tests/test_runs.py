import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from versefold.functions import text as tx
from versefold.operators import calls
from versefold.operators import controller as ct
from versefold.operators import eventlog as ev
from versefold.operators import resume as rs
from versefold.operators import tagging as ta
from versefold.operators import timeline as tl
from versefold.schema import EVENT
from versefold.sources import readers, writers
from versefold.streaming import live


def outcomes(spark, rows):
    return spark.createDataFrame([("k", i + 1, lat, err) for i, (lat, err) in enumerate(rows)], "key string, seq long, latency_s double, error string")


def test_controller_steps(spark):
    rows = [(1.0, None)] * 5 + [(2.0, None)] * 3
    got = [(r.target, r.reason) for r in ct.trace(outcomes(spark, rows), "key", ["seq"]).orderBy("seq").collect()]
    assert got == [(3, None)] * 7 + [(2, "median 2.0s vs baseline 1.0s")]
    got = [(r.target, r.reason) for r in ct.trace(outcomes(spark, [(None, "rate_limit"), (None, "server"), (None, "timeout"), (None, "other")]), "key", ["seq"]).orderBy("seq").collect()]
    assert got == [(2, "429 received"), (1, "5xx received"), (1, None), (1, None)]


@pytest.mark.parametrize("ramp", [False, True])
def test_controller_ramp(spark, ramp):
    rows = [(1.0, None)] * 5 + [(None, "server")] + [(1.0, None)] * 25
    got = [r.target for r in ct.trace(outcomes(spark, rows), "key", ["seq"], ramp_up=ramp).orderBy("seq").collect()]
    assert got[5] == 2 and max(got) == 3
    assert got[-1] == (3 if ramp else 2)


def test_streamed_controller_matches_batch(spark, tmp_path):
    rows = [(float(1 + (i * 7) % 5), "server" if i % 9 == 4 else None) for i in range(60)]
    batch = {r.seq: r.target for r in ct.trace(outcomes(spark, rows), "key", ["seq"], ramp_up=True).collect()}
    for part in range(3):
        outcomes(spark, rows).where(f"seq > {part * 20} and seq <= {part * 20 + 20}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, latency_s double, error string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = live.live_trace(stream, ramp_up=True).writeStream.format("memory").queryName("traced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.target for r in spark.table("traced").collect()} == batch


def test_courtesy(spark):
    arrivals = [0.0, 0.1, 0.2, 5.0, 5.05, 9.0]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(arrivals)], "k int, i int, arrival_s double")
    got = [r.start_s for r in ct.courtesy_starts(df, ["k"], ["i"]).orderBy("i").collect()]
    want, last = [], None
    for a in arrivals:
        last = a if last is None else max(a, last + 0.3)
        want.append(last)
    assert got == pytest.approx(want)


def test_ordered_results_and_attempts(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (1, 2, "x", None), (1, 3, None, "d")], "k int, idx long, error string, result string")
    assert [(r.idx, r.result) for r in ct.ordered_results(df, ["k"]).orderBy("idx").collect()] == [(0, "a"), (1, None), (2, None), (3, "d")]
    assert [r.line for r in ct.failures(df).collect()] == ["chunk 2 failed: x"]
    far = spark.createDataFrame([(1, 200_000, None, "z")], "k int, idx long, error string, result string")
    assert ct.ordered_results(far, ["k"]).agg(F.count("*"), F.max("idx"), F.count("result")).first() == (200_001, 200_000, 1)
    tries = spark.createDataFrame([(1, 0, "failed", "e"), (1, 1, "done", None), (2, 0, "failed", "e")], "job int, attempt int, status string, error string")
    assert [(r.job, r.attempts, r.status, r.error) for r in ct.final_attempts(tries, ["job"]).orderBy("job").collect()] == [(1, 1, "done", None), (2, 0, "failed", "e")]


def chapter(spark):
    return spark.createDataFrame([(1, 0, "title", "ends_section", 400), (1, 1, "body", "mid_paragraph", 1000), (1, 2, "body", "ends_paragraph", 1000), (1, 3, "body", "ends_section", 1000)], "c int, position int, kind string, boundary string, duration_ms long")


def test_timeline(spark):
    rows = tl.gaps(chapter(spark), ["c"], ["position"], gap_ms=300, title_gap_ms=700)
    assert [r.gap_ms for r in rows.orderBy("position").collect()] == [700, 300, 300, None]
    assert [r.start_ms for r in tl.offsets(rows, ["c"], ["position"]).orderBy("position").collect()] == [0, 1100, 2400, 3700]
    assert tl.durations(rows, ["c"]).first().duration_ms == 4700
    mid = tl.gaps(chapter(spark), ["c"], ["position"], mid_paragraph_gap_ms=0)
    assert [r.gap_ms for r in mid.orderBy("position").collect()] == [3000, 0, 900, None]
    assert sorted(r.gap_ms for r in tl.distinct_gaps(mid).collect()) == [0, 900, 3000]
    parts = tl.segments(rows.withColumn("path", F.lit("o'x\\y.wav")), ["c"], ["position"], "path")
    assert tl.concat_list(parts, ["c"], ["position", "part"]).first().list.split("\n")[:2] == ["file 'o'\\''x/y.wav'", "file 'gap_700ms.wav'"]
    book = tl.book_timeline(spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "b int, o int, duration_ms long"), ["b"], ["o"])
    assert [(r.gap_ms, r.start_ms) for r in book.orderBy("o").collect()] == [(2000, 0), (None, 2010)]


def test_resume(spark):
    chunks = spark.createDataFrame([("c1", "One."), ("c2", "Two."), ("c3", "***")], "chunk_id string, text string")
    tags = spark.createDataFrame([("c1", "weary")], "chunk_id string, tag string")
    plan = rs.planned(chunks, tags, ["chunk_id"])
    manifest = plan.select("chunk_id", "text_hash", F.lit("w").alias("wav_path"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(rs.pending(plan, manifest, ["chunk_id"])) == []
    assert ids(rs.skipped(plan, manifest, ["chunk_id"])) == ["c1", "c2", "c3"]
    assert ids(rs.pending(rs.planned(chunks, None, ["chunk_id"]), manifest, ["chunk_id"])) == ["c1"]
    assert ids(rs.pending(plan, manifest, ["chunk_id"], force=True)) == ["c1", "c2", "c3"]
    assert ids(rs.pending(plan, manifest, ["chunk_id"], files=spark.createDataFrame([("other",)], "wav_path string"))) == ["c1", "c2", "c3"]
    again = rs.upsert(manifest, manifest.where("chunk_id = 'c1'").withColumn("status", F.lit("failed")), ["chunk_id"])
    assert {r.chunk_id: r.status for r in again.collect()} == {"c1": "failed", "c2": "done", "c3": "done"}
    quick = calls.Limits(delay_s=0, sleep=no_wait)
    done = writers.render(plan, lambda t: b"" if "Two" in t else b"RIFF", ["chunk_id"], limits=quick)
    assert {r.chunk_id: r.attempts for r in done.collect()} == {"c1": 1, "c2": 3, "c3": 0}
    assert {r.chunk_id: (r.status, r.error) for r in done.collect()} == {"c1": ("done", None), "c2": ("failed", "empty answer"), "c3": ("done", None)}


def no_wait(seconds):
    pass


def test_calls():
    waits, tries = [], []

    class Busy(Exception):
        retry_after = 7

    def answer(k):
        tries.append(k)
        if k == 1 and tries.count(1) < 3:
            raise Busy("slow down (429)") if tries.count(1) == 1 else RuntimeError("gone (503)")
        if k == 2:
            raise ValueError("never")
        if k == 3:
            time.sleep(0.5)
        return k * 10

    got = list(calls.call_all(answer, range(5), calls.Limits(start=2, timeout_s=0.2, delay_s=0, sleep=waits.append)))
    by = {o.index: o for o in got}
    assert {k: (o.value, o.error, o.attempts) for k, o in by.items()} == {0: (0, None, 1), 1: (10, None, 3), 2: (None, "never", 3), 3: (None, "timed out after 0.2s", 3), 4: (40, None, 1)}
    assert sorted(waits) == [2.0, 2.0, 4.0, 4.0, 4.0, 7.0]
    assert [c for o in got for c in o.changes] == [(2, 1, "429 received")]
    assert list(calls.call_all(answer, [], calls.Limits())) == []
    most, now, lock = [0], [0], threading.Lock()

    def count(_):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1

    assert len(list(calls.call_all(count, range(12), calls.Limits(start=3, delay_s=0)))) == 12
    assert most[0] == 3
    paced = []
    list(calls.call_all(lambda _: None, range(4), calls.Limits(start=1, delay_s=10, sleep=paced.append)))
    assert len(paced) == 3 and all(9 < w <= 10 for w in paced)


def test_upserts_take_the_last(spark):
    kept = []
    batch = spark.createDataFrame([("a", 1, "failed"), ("a", 3, "done"), ("a", 2, "failed"), ("b", 1, "failed")], "chunk_id string, at int, status string")
    old = spark.createDataFrame([("a", 0, "old"), ("c", 0, "old")], "chunk_id string, at int, status string")
    writers.upsert_batches(lambda: old, kept.append, ["chunk_id"], "at")(batch, 0)
    assert {r.chunk_id: r.status for r in kept[0].collect()} == {"a": "done", "b": "failed", "c": "old"}


def test_responses(spark):
    answers = spark.createDataFrame([(1, '```json\n{"items":[{"chunk_id":"a","tag":"weary"},{"chunk_id":"a","tag":"cold"},{"chunk_id":"zz","tag":"cold"},{"tag":"cold"}]}\n```'), (2, "nonsense"), (3, None)], "b int, answer string")
    chunks = spark.createDataFrame([(1, "a", "Hello."), (1, "b", "Bye.")], "b int, chunk_id string, text string")
    items = ta.validate_response(ta.parse_response(answers, "answer", ["b"]), chunks, ["b"])
    assert [r.reason for r in items.orderBy("b", "item").collect()] == [None, None, "unknown chunk_id (not in requested batch)", "malformed item (missing chunk_id or tag)"]
    tags = ta.accepted(items, ["b"])
    assert [(r.chunk_id, r.tag) for r in tags.collect()] == [("a", "cold")]
    assert {r.chunk_id: r.tag for r in ta.review(ta.with_tags(chunks, tags, ["b", "chunk_id"]), ["b", "chunk_id"]).collect()} == {"a": "cold", "b": None}
    proposed = ta.propose_tags(chunks.withColumn("text", F.concat("text", F.lit("!"))), ta.backends()["by-mark"](), ["b", "chunk_id"])
    assert {r.tag for r in proposed.collect()} == {"urgent"}

    def broken(batch):
        raise RuntimeError

    assert ta.propose_tags(chunks, broken, ["b", "chunk_id"]).count() == 0


def test_events(spark, tmp_path):
    rows = spark.range(3).select(ev.event("chunk_done", chunk_id=F.concat(F.lit("ch01_000"), F.col("id").cast("string")), i=F.col("id"), latency_s=F.lit(1.5)).alias("e")).select(*[F.col(f"e.`{f.name}`") for f in EVENT.fields])
    bad = spark.range(1).select(ev.event("error", message=F.lit("key " + "A" * 24)).alias("e")).select(*[F.col(f"e.`{f.name}`") for f in EVENT.fields])
    writers.write_events(rows.unionByName(bad), str(tmp_path / "log"), str(tmp_path / "held"))
    assert readers.read_events(spark, str(tmp_path / "log")).count() == 3
    assert readers.read_events(spark, str(tmp_path / "held")).count() == 1
    assert ev.progress(readers.read_events(spark, str(tmp_path / "log"))).first().asDict() == {"chapter_id": "ch01", "done": 3, "failed": 0, "seconds": 4.5}
    q = live.live_progress(readers.stream_events(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("progress").first().done == 3
    one = spark.range(1).select(ev.line("concurrency_changed", from_=F.lit(3), to=F.lit(2), reason=F.lit(None).cast("string")).alias("x")).first().x
    assert json.loads(one) == {"event": "concurrency_changed", "from": 3, "to": 2, "reason": None}
    with pytest.raises(ValueError, match="no such fields"):
        ev.event("done", latency_s=F.lit(1))


def test_files(spark, tmp_path):
    (tmp_path / "My Book.txt").write_bytes("Chapter 1\r\nHi.".encode())
    book = readers.read_books(spark, str(tmp_path / "My Book.txt")).first()
    assert (book.book_id, book.text) == ("My_Book", "Chapter 1\nHi.")
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "It's 1+1%.txt").write_text(folder)
    (tmp_path / "b" / "other.txt").write_text("x")
    names = [r.book_id for r in readers.read_books(spark, str(tmp_path / "[ab]" / "*.txt")).collect()]
    assert len(set(names)) == 3 and "other" in names and sum(n.startswith("It_s_1_1-") for n in names) == 2
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "v.wav").write_bytes(bytes(spark.range(1).select(tx.silent_wav(F.lit(500), 22050)).first()[0]))
    (tmp_path / "clips" / "v.txt").write_text(" Hello. ")
    clip = readers.reference_faults(readers.read_reference(spark, str(tmp_path / "clips"))).first()
    assert (clip.seconds, clip.sample_rate, clip.channels, clip.sample_format, clip.transcript, clip.fault) == (0.5, 22050, 1, "s16", "Hello.", "not at 44100 Hz")
    assert readers.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"chunks": {"c1": {"chunk_id": "c1", "text_hash": "h", "wav_path": "w", "status": "done"}}}))
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).first().status == "done"
    (tmp_path / "tags.json").write_text(json.dumps([{"chunk_id": "a", "text_preview": "x", "tag": "cold"}, {"chunk_id": "b", "tag": None}, {"chunk_id": "a", "tag": "warm"}, {"chunk_id": "c", "tag": ""}]))
    assert [(r.chunk_id, r.tag) for r in readers.read_tags(spark, str(tmp_path / "tags.json")).collect()] == [("a", "warm")]
    chapters = spark.createDataFrame([(1, "ch00", None, "", "t"), (1, "ch01", "1", "", "")], "b int, chapter_id string, number string, title string, text string")
    chunks = spark.createDataFrame([(1, "ch00", f"ch00_000{k}", k, "t", 1, "h", "body", "ends_section", False) for k in (1, 0)], "b int, chapter_id string, chunk_id string, position int, text string, char_count int, text_hash string, kind string, boundary string, over_cap boolean")
    nested = writers.nested_chapters(chapters, chunks, ["b", "chapter_id"], ["b"]).orderBy("chapter_id").collect()
    assert [[c.position for c in r.chunks] for r in nested] == [[0, 1], []]
    (tmp_path / "chunks.json").write_text(json.dumps([{k: v for k, v in r.asDict(True).items() if k != "b"} for r in nested]))
    got_chapters, got_chunks = readers.read_chapters_file(spark, str(tmp_path / "chunks.json"))
    assert (got_chapters.count(), got_chunks.count()) == (2, 2)
    one = writers.manifest_files(spark.createDataFrame([(1, "c1", "h", "w", "done", None)], "b int, chunk_id string, text_hash string, wav_path string, status string, error string"), ["b"]).first().value
    assert json.loads(one) == {"chunks": {"c1": {"chunk_id": "c1", "text_hash": "h", "wav_path": "w", "status": "done"}}}


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"gaps": {"chunk_gap_ms": 1}, "chunking": {"max_chars": 9}}))
    (tmp_path / ".env").write_text("VERSEFOLD_GAPS__TITLE_GAP_MS=5\nVERSEFOLD_CHUNKING__MAX_CHARS=7\n")
    monkeypatch.setenv("VERSEFOLD_CHUNKING__MAX_CHARS", "8")
    got = readers.load_config(str(tmp_path / "c.json"), {"concurrency": {"ramp_up": True}}, dotenv=str(tmp_path / ".env"))
    assert got["gaps"] == {"chunk_gap_ms": 1, "title_gap_ms": 5, "chapter_gap_ms": 2000, "mid_paragraph_gap_ms": None}
    assert got["chunking"]["max_chars"] == 8 and got["concurrency"]["ramp_up"] is True
