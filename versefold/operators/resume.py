"""Incremental work: what a manifest says is done, what is pending, and how outcomes update it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import speakable, tagged, text_hash


def planned(chunks: DataFrame, tags: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """chunks with applied (the text that is spoken), text_hash over text and tag, and speakable (of the text) and speakable_applied (of text and tag).

    The tag is that of `tags` for the keys `on`, or, without such a table, the chunks' own column of that name (none: no tag).
    """
    if tags is not None:
        rows = chunks.drop("tag").join(tags, on, "left")
    else:
        rows = chunks if "tag" in chunks.columns else chunks.withColumn("tag", F.lit(None).cast("string"))
    return rows.withColumns({"applied": tagged(F.col("text"), F.col("tag")), "text_hash": text_hash(F.col("text"), F.col("tag")), "speakable": speakable(F.col("text")), "speakable_applied": speakable(tagged(F.col("text"), F.col("tag")))})


def _done(manifest: DataFrame, on: list[str], files: DataFrame | None) -> DataFrame:
    done = manifest.where("status = 'done'")
    if files is not None:
        done = done.join(files.select("wav_path").distinct(), "wav_path", "left_semi")
    return done.select(*on, "text_hash").distinct()


def pending(plan: DataFrame, manifest: DataFrame, on: list[str], files: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Chunks to do: all that aren't done with the same hash (and, with files, whose file is there)."""
    return plan if force else plan.join(_done(manifest, on, files), [*on, "text_hash"], "left_anti")


def skipped(plan: DataFrame, manifest: DataFrame, on: list[str], files: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Chunks that are done, with a latency of 0."""
    rows = plan.join(_done(manifest, on, files), [*on, "text_hash"], "left_semi")
    return (rows.where(F.lit(False)) if force else rows).withColumn("latency_s", F.lit(0.0))


def upsert(manifest: DataFrame, outcomes: DataFrame, on: list[str]) -> DataFrame:
    """The manifest with the outcomes' rows in place of those of the same keys."""
    return manifest.join(outcomes.select(*on).distinct(), on, "left_anti").unionByName(outcomes.select(*manifest.columns))


def to_stitch(chunks: DataFrame, manifest: DataFrame, on: list[str], default: F.Column, files: DataFrame | None = None) -> DataFrame:
    """chunks with wav_path, by the manifest or by default, and missing (whether no such file is listed)."""
    rows = chunks.join(manifest.select(*on, F.col("wav_path").alias("_wav")), on, "left").withColumn("wav_path", F.coalesce("_wav", default)).drop("_wav")
    if files is None:
        return rows.withColumn("missing", F.lit(False))
    there = files.select("wav_path").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "wav_path", "left").withColumn("missing", F.col("_there").isNull()).drop("_there")
