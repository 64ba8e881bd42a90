"""A corpus from documents: five stages, each an operator of versefold.llm over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. run() writes each stage's result
as Parquet in the shared folder, reads it again, and removes the table before it.

Nulls, empty and very long texts, repeated rows, further columns of any names and empty tables: a null or empty text is
never toxic, has one empty line, no near copies and no passages, and takes no words. Repeated rows have one fate each,
but for near duplicates, where one of them stays. Further columns pass through all stages but the last, which has its
own. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from versefold.llm.common import drop_table, shared_path, shared_table, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on labelled ones, doesn't predict to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows."""
    out = line_dedup.drop_repeated_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.mark_contaminated(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document, the words that the mix takes of it (0: it isn't in the mix)."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: SQL can't express the first stage's model, nor sampled keys; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_path(spark)
        docs = shared_table(stage(spark, docs, sf_dir), path)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
