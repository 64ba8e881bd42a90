"""Sinks: nested chunk files, manifests, review files, event lines, lists, audio bytes, and a pluggable renderer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import silent_wav, speakable
from ..operators.calls import Limits, call_all
from ..operators.eventlog import scrubbed
from ..operators.resume import upsert
from ..schema import CHUNK, EVENT


def write_table(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet, in a folder for each value of `by`; the committer shows all files or none. The mode `replace` writes over the folders that df has rows for and leaves the others."""
    how = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "replace" else df.write.mode(mode)
    how.partitionBy(*by).parquet(path)


def nested_chapters(chapters: DataFrame, chunks: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """(*keep, chapter_id, number, title, text, chunks), chunks in order of position; empty where there are none."""
    body = F.struct(*[f.name for f in CHUNK.fields])
    lists = chunks.groupBy(*on).agg(F.array_sort(F.collect_list(body), lambda a, b: a["position"] - b["position"]).alias("chunks"))
    joined = chapters.join(lists, on, "left")
    return joined.select(*keep, "chapter_id", "number", "title", "text", F.coalesce("chunks", F.array().cast(f"array<{CHUNK.simpleString()}>")).alias("chunks"))


def write_chapters(chapters: DataFrame, chunks: DataFrame, on: list[str], keep: list[str], path: str) -> None:
    nested_chapters(chapters, chunks, on, keep).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def manifest_files(manifest: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, value): each chapter's manifest as one JSON object."""
    entry = F.struct("chunk_id", "text_hash", "wav_path", "status", "error")
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", entry.alias("e")))))
    return manifest.groupBy(*keep).agg(F.to_json(F.struct(entries.alias("chunks"))).alias("value"))


def write_review(review: DataFrame, path: str, *by: str) -> None:
    review.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(*by).json(path)


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], on: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch of outcomes is put into the manifest; of a key's several, the one of the largest order."""

    def fn(batch: DataFrame, _: int) -> None:
        old = read()
        rest = [c for c in batch.columns if c not in on]
        last = batch.groupBy(*on).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*on, *[F.col(f"_r.`{c}`") for c in rest])
        write(upsert(old, last, on))

    return fn


def write_events(events: DataFrame, path: str, quarantine: str) -> None:
    """JSON lines without null fields; rows with key-shaped values go to quarantine."""
    good, bad = scrubbed(events.select(*[f.name for f in EVENT.fields]))
    good.write.mode("append").json(path)
    bad.write.mode("append").json(quarantine)


def write_lists(lists: DataFrame, path: str, *by: str) -> None:
    lists.withColumnRenamed("list", "value").write.mode("overwrite").partitionBy(*by).option("lineSep", "").text(path)


def render(plan: DataFrame, synthesise: Callable[[str], bytes], on: list[str], silence_ms: int = 200, limits: Limits | None = None, tasks: int = 1) -> DataFrame:
    """(*on, audio, status, error, attempts, latency_s, concurrency, changes): silence for what can't be spoken, else what a callable makes of the applied text.

    The callable runs in `tasks` tasks, each with a pool of its own under `limits` (a service with one limit for all
    takes one task, which is the default). Calls that fail are tried again; an empty answer is an error; an error fails
    the row, not the job. changes are the controller's steps (from, to, reason) before the row.
    """
    own = ", audio binary, status string, error string, attempts int, latency_s double, concurrency int, changes array<struct<`from`: int, `to`: int, reason: string>>"
    schema = ", ".join(f"{c} {dict(plan.dtypes)[c]}" for c in on) + own
    limits = limits or Limits()

    def ask(row: dict) -> bytes:
        got = synthesise(row["applied"])
        if not got:
            raise ValueError("empty answer")
        return got

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []

        def fed() -> Iterator[dict]:
            for frame in frames:
                for row in frame.to_dict("records"):
                    rows.append({c: row[c] for c in on})
                    yield row

        for got in call_all(ask, fed(), limits):
            out = rows[got.index] | {"audio": got.value, "status": "failed" if got.error else "done", "error": got.error, "attempts": got.attempts, "latency_s": got.latency_s, "concurrency": got.concurrency}
            rows[got.index] = None
            yield pd.DataFrame([out | {"changes": [{"from": a, "to": b, "reason": r} for a, b, r in got.changes]}])

    spoken = plan.where(speakable(F.col("applied"))).select(*on, "applied").repartition(tasks).mapInPandas(run, schema)
    silent = plan.where(~speakable(F.col("applied"))).select(
        *on, silent_wav(F.lit(silence_ms)).alias("audio"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(0.0).alias("latency_s"),
        F.lit(limits.start).alias("concurrency"), F.array().cast("array<struct<`from`: int, `to`: int, reason: string>>").alias("changes"),
    )
    return spoken.unionByName(silent)
