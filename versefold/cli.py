"""Command line: chunk, tag, generate, stitch, run and clip, over stage tables in an output folder.

    python -m versefold.cli run --book 'books/*.txt' --out out [--chapters 1-3] [--tagger by-mark] ...

Each command reads and writes Parquet tables of the folder: chapters, chunks, tags, manifest, audio, failures, inputs,
timeline, lists; event lines go to events, those with key-shaped values to quarantine. `generate` calls the function
that --synthesiser names (module:function, text to WAV bytes; without one, silence), for what the manifest doesn't say
is done: --concurrency calls at once, fewer while the service is slow or refuses, more again with --ramp-up.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chapters import selected
from .functions.text import chapter_path, wav_seconds
from .operators import chunks as ck
from .operators import controller as ct
from .operators import eventlog as ev
from .operators import resume as rs
from .operators import segments as sg
from .operators import tagging as ta
from .operators import timeline as tl
from .operators.calls import Limits
from .schema import EVENT
from .sources import readers, writers

KEYS = ["book_id", "ordinal", "position"]
MANIFEST = "book_id string, ordinal int, position int, text_hash string, wav_path string, status string, error string"


class Run:
    """The stages over one output folder."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        over: dict = {}
        if args.gap_ms is not None:
            over["gaps"] = {"chunk_gap_ms": args.gap_ms}
        if args.concurrency is not None or args.ramp_up:
            over["concurrency"] = {k: v for k, v in (("start", args.concurrency), ("ramp_up", args.ramp_up or None)) if v is not None}
        if args.tagger is not None:
            over["tagging"] = {"backend": args.tagger}
        self.spark, self.args, self.out = spark, args, args.out.rstrip("/")
        self.config = readers.load_config(args.config, over, dotenv=".env")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def table_or_none(self, name: str) -> DataFrame | None:
        try:
            return self.table(name)
        except AnalysisException:
            return None

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        writers.write_table(df, f"{self.out}/{name}", *by)
        return self.table(name)

    def emit(self, events: Column, rows: DataFrame) -> None:
        writers.write_events(rows.select(events.alias("_e")).select(*[F.col(f"_e.`{f.name}`") for f in EVENT.fields]), f"{self.out}/events", f"{self.out}/quarantine")

    def chosen(self, df: DataFrame) -> DataFrame:
        return df.where(selected(F.col("chapter_id"), self.args.chapters))

    def chunk(self) -> None:
        """Books to chapters and chunks; always from the books, as they may have changed."""
        sizes = self.config["chunking"]
        books = readers.read_books(self.spark, self.args.book)
        chapters = self.save(sg.split_chapters(books, "text", ["book_id"]), "chapters", "book_id")
        sized = {"target": sizes["target_chars"], "cap": sizes["max_chars"], "least": sizes["min_chars"], "limit": sizes["hard_split_chars"]}
        chunks = self.save(ck.book_chunks(books, "text", ["book_id"], **sized), "chunks", "book_id")
        counts = ck.chunk_counts(chapters, chunks, ["book_id", "ordinal", "chapter_id"])
        self.emit(ev.event("chunked", chapter_id=F.col("chapter_id"), chunk_count=F.col("chunk_count")), counts)

    def tag(self) -> None:
        """Proposed tags, validated; those of other chapters stay."""
        chunks = self.chosen(self.table("chunks"))
        proposed = ta.propose_tags(chunks, ta.get_backend(self.config["tagging"]["backend"]), KEYS)
        names = F.concat_ws("/", *KEYS)
        known = chunks.select(names.alias("chunk_id"), *KEYS, "text")
        items = proposed.select(names.alias("chunk_id"), "tag").withColumn("item", F.lit(0))
        good = ta.accepted(ta.validate_response(items, known.select("chunk_id", "text"), []), [])
        tags = known.join(good, "chunk_id").select(*KEYS, "tag")
        old = self.table_or_none("tags")
        if old is not None:
            tags = ta.merge_tags(old.select(*KEYS, "tag"), tags, on=KEYS)
        merged = self.save(tags, "tags.new")
        tags = self.save(merged, "tags")
        every = self.table("chunks")
        writers.write_review(ta.review(ta.with_tags(every, tags, KEYS), [*KEYS, "chunk_id"]), f"{self.out}/tags_review")
        by = ta.coverage(ta.with_tags(chunks, tags, KEYS), ["book_id", "ordinal", "chapter_id"])
        self.emit(ev.event("tagged", chapter_id=F.col("chapter_id"), tagged_count=F.col("tagged_count"), dropped_count=F.col("dropped_count")), by)

    def plan(self) -> DataFrame:
        return rs.planned(self.chosen(self.table("chunks")), self.table_or_none("tags"), KEYS)

    def manifest(self) -> DataFrame:
        found = self.table_or_none("manifest")
        return self.spark.createDataFrame([], MANIFEST) if found is None else found

    def generate(self) -> int:
        """Audio for what is pending, under the limits of the configuration; outcomes go to the manifest. The number of failures."""
        plan, manifest = self.plan(), self.manifest()
        todo = rs.pending(plan, manifest, KEYS, force=self.args.force)
        module, _, name = (self.args.synthesiser or "").partition(":")
        speak = getattr(importlib.import_module(module), name) if module else _silence
        calls, start = self.config["calls"], max(1, int(self.config["concurrency"]["start"]))
        limits = Limits(start=start, ramp_up=bool(self.config["concurrency"]["ramp_up"]), attempts=int(calls["attempts"]), timeout_s=float(self.config["timeout_s"]), delay_s=float(calls["courtesy_delay_s"]))
        path = F.concat_ws("/", "book_id", F.concat("chunk_id", F.lit(".wav")))
        made = self.save(writers.render(todo.withColumn("wav_path", path), speak, [*KEYS, "chunk_id", "chapter_id", "text_hash", "wav_path"], limits=limits), "audio.new")
        size = self.table("chunks").groupBy("book_id", "ordinal").agg(F.count("*").alias("n"))
        skipped = rs.skipped(plan, manifest, KEYS, force=self.args.force).join(size, ["book_id", "ordinal"])
        self.emit(ev.event("chunk_done", chunk_id=F.col("chunk_id"), i=F.col("position"), n=F.col("n"), latency_s=F.col("latency_s"), concurrency=F.lit(start)), skipped)
        outcomes = made.select(*KEYS, "text_hash", "wav_path", "status", "error")
        done = self.save(rs.upsert(manifest, outcomes, KEYS), "manifest.new")
        # Audio is kept by its hash, so that a run adds files and rewrites none; the manifest says which hash counts.
        writers.write_table(made.where("status = 'done'").select(*KEYS, "text_hash", "wav_path", "audio", F.left("text_hash", F.lit(2)).alias("part")), f"{self.out}/audio", "part", mode="append")
        self.save(done, "manifest")
        named = made.join(size, ["book_id", "ordinal"])
        self.emit(ev.event("chunk_done", chunk_id=F.col("chunk_id"), i=F.col("position"), n=F.col("n"), latency_s=F.col("latency_s"), concurrency=F.col("concurrency")), named.where("status = 'done'"))
        self.emit(ev.event("chunk_failed", chunk_id=F.col("chunk_id"), i=F.col("position"), n=F.col("n"), error=F.col("error")), named.where("status = 'failed'"))
        steps = made.select(F.inline("changes"))
        self.emit(ev.event("concurrency_changed", from_=F.col("from"), to=F.col("to"), reason=F.col("reason")), steps)
        failed = ct.failures(made, "position", F.col("chunk_id"))
        self.save(failed.select(*KEYS, "chunk_id", "line"), "failures")
        return failed.count()

    def stitch(self) -> None:
        """Timelines and lists of the chapters that have audio; with --single-file, of whole books.

        A chunk's audio is that of the hash its manifest row has; one without is a row of `inputs` with `missing`, and in no list.
        """
        gap = self.config["gaps"]
        files = self.table("audio").groupBy("wav_path", "text_hash").agg(F.first("audio").alias("audio"))
        files = files.select("wav_path", "text_hash", (wav_seconds(F.col("audio")) * 1000).cast("long").alias("duration_ms"))
        valid = self.manifest().where("status = 'done'")
        default = F.concat_ws("/", "book_id", F.concat("chunk_id", F.lit(".wav")))
        inputs = rs.to_stitch(self.plan(), valid, KEYS, default).drop("missing").join(files, ["wav_path", "text_hash"], "left").withColumn("missing", F.col("duration_ms").isNull())
        rows = self.save(inputs, "inputs", "book_id").where("not missing")
        rows = tl.gaps(rows, ["book_id", "ordinal"], ["position"], gap_ms=gap["chunk_gap_ms"], title_gap_ms=gap["title_gap_ms"], mid_paragraph_gap_ms=gap["mid_paragraph_gap_ms"])
        timeline = self.save(tl.offsets(rows, ["book_id", "ordinal"], ["position"]), "timeline", "book_id")
        parts = tl.segments(timeline, ["book_id", "ordinal"], ["position"], "wav_path")
        self.save(tl.concat_list(parts, ["book_id", "ordinal"], ["position", "part"]), "lists", "book_id")
        ends = tl.durations(timeline, ["book_id", "ordinal", "chapter_id"])
        heads = self.table("chapters").select("book_id", "ordinal", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("chapter_id")).alias("title"))
        number = F.coalesce(F.regexp_extract("chapter_id", "^ch([0-9]+)", 1).try_cast("int"), F.lit(0))
        ends = self.save(ends.join(heads, ["book_id", "ordinal"]).withColumn("path", chapter_path(F.col("book_id"), number, F.col("title"))), "outputs")
        self.emit(ev.event("stitched", chapter_id=F.col("chapter_id"), path=F.col("path"), duration_s=F.col("duration_ms") / 1000), ends)
        if self.args.single_file:
            self.save(tl.book_timeline(ends, ["book_id"], ["ordinal"], gap["chapter_gap_ms"]), "book_timeline")

    def all(self) -> int:
        self.emit(ev.event("run_started", book=F.lit("run"), tagger=F.lit(self.config["tagging"]["backend"])), self.spark.range(1))
        self.chunk()
        self.tag()
        if self.args.tags_review:
            return 0
        failed = self.generate()
        self.stitch()
        done = self.table("outputs").groupBy("book_id").agg(F.count("*").alias("n"))
        self.emit(ev.event("done", book=F.col("book_id"), chapters_done=F.col("n"), failed_chunks=F.lit(failed)), done)
        return 0


def _silence(text: str) -> bytes:
    """A stand-in for speech: 60 ms of silence a character."""
    n = 2 * (44100 * 60 * len(text) // 1000)
    head = (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + (44100).to_bytes(4, "little") + (88200).to_bytes(4, "little") + b"\2\0\x10\0data" + n.to_bytes(4, "little")
    return b"RIFF" + head + bytes(n)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="versefold", description="Books to timelines.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("chunk", "tag", "generate", "stitch", "run"):
        c = commands.add_parser(name)
        c.add_argument("--book", required=name in ("chunk", "run"))
        c.add_argument("--out", required=True)
        for option in ("--config", "--chapters", "--tagger", "--synthesiser"):
            c.add_argument(option)
        for option in ("--gap-ms", "--concurrency"):
            c.add_argument(option, type=int)
        for option in ("--ramp-up", "--single-file", "--force", "--tags-review"):
            c.add_argument(option, action="store_true")
    clip = commands.add_parser("clip", help="print an external encoder's arguments for a reference clip")
    clip.add_argument("source")
    clip.add_argument("target")
    clip.add_argument("--start", type=float)
    clip.add_argument("--duration", type=float)
    clip.add_argument("--clean", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "clip":
        print(*tl.clip_arguments(args.source, args.target, args.start, args.duration, args.clean))
        return 0
    run = Run(spark or SparkSession.builder.appName("versefold").getOrCreate(), args)
    result = run.all() if args.command == "run" else getattr(run, args.command)()
    return int(result or 0)


if __name__ == "__main__":
    sys.exit(main())
