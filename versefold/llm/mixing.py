"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Each document gets an exponential key, scaled by its quality weight, from a hash of its id; small keys come first.
A source's budget is whole epochs of the source and then a fraction of one: the documents in order of their keys,
until their sizes sum to what is left. Where that ends is found in two rounds of bins by the logarithm of the key: sums
by source and bin (a small table, pre-aggregated before its shuffle) tell which bin holds the end, and sums by finer
bins within that one tell where in it. A bin of the first round holds some 1 % of a source at most, whatever its
weights, and one of the second some millionths. Only the last one's documents are sorted, so a source with a third of
all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, table

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 20
#: Bins to a unit of the logarithm of the key, and bins within one of these.
COARSE, FINE = 32, 4096
#: Sampling weights of a document by its label: good, unlabelled, bad.
QUALITY = {"good": 1.0, "none": 0.7, "bad": 0.3}


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def ranked(values: DataFrame, key: str, out: str) -> DataFrame:
    """The rows of values (distinct keys) with their rank from 0 by key, nulls last: a distributed sort, counts by partition, offsets."""
    order = F.col(key).asc_nulls_last()
    parts = shared_checkpoint(values.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect())
    start, starts = 0, []
    for p, n in counts:
        starts.append((p, start))
        start += n
    offsets = parts.sparkSession.createDataFrame(starts, "_p int, _s long")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.join(offsets, "_p").withColumn(out, within - 1 + F.col("_s")).drop("_p", "_s")


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """A row for each source (source, source_size, target): share of all words, dealt by weight, none above repeats times its size.

    What is cut off is dealt again by weight among the rest until none is above; each round is a sum over the sources.
    """
    by = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    by = ranked(by, source, "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    by = shared_checkpoint(by.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(repeats)).withColumn("_full", F.lit(False)))
    total = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        x = by.agg(F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)), F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))), F.count_if("_full")).first()
        if not x[1] or x[2] == n_full:
            break
        n_full, level = x[2], (total - x[0]) / x[1]
        by = by.withColumn("_full", F.col("_w") * F.lit(level) >= F.col("_cap"))
    return by.select(source, "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential variable with the rate `weight`, by a hash of the id: of rows in its order, the first is each with a probability in proportion to its weight."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 11) + F.lit(0.5)) / float(1 << 53)
    return -F.log(uniform) / weight


def sampling_weight(quality: Column) -> Column:
    return F.when(quality == 1, QUALITY["good"]).when(quality == 0, QUALITY["bad"]).otherwise(QUALITY["none"])


def _end(rows: DataFrame, bin_: str, goal: DataFrame, start: Column, out: str) -> DataFrame:
    """goal with the bin in which each source's budget ends, and the words before it; null where it ends in none."""
    sums = rows.groupBy("source", bin_).agg(F.sum("size").alias("_n"))
    own = F.sum("_n").over(Window.partitionBy("source").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1))
    found = sums.withColumn("_b", F.coalesce(own, F.lit(0))).withColumnRenamed("source", "_of").join(goal, F.col("_of").eqNullSafe(F.col("_source")))
    before = start + F.col("_b")
    found = found.where((before < F.col("_left")) & (F.col("_left") <= before + F.col("_n"))).select("_of", F.col(bin_).alias(f"_end{out}"), before.alias(f"_before{out}"))
    return shared_checkpoint(goal.join(found, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of"))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes of the row, repeats counted); other columns are left out.

    size: runs of non-blanks in the whole text, however long, 0 for null. Sources in order of code points, null last,
    weigh as `weights`, repeating. quality: rows (doc_id, quality); 1, 0 or no label give the sampling weights QUALITY.
    Every row is taken for each whole epoch; the row at which the budget of the last, partial epoch ends is taken in
    part, so a source's words come to its target but for rounding. Ties of the key go by doc_id, then by size; rows
    equal in all of these share one place, and the budget's end is dealt over them in any order. A null doc_id is a
    value like others. Without rows, or words, nothing is taken.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_in_words(F.col(text)).alias("size"))
    if quality is not None:
        graded = quality.groupBy(F.col("doc_id").alias("_q_id")).agg(F.max("quality").alias("_q"))
        slim = slim.join(graded, slim["doc_id"] == graded["_q_id"], "left").drop("_q_id")
    else:
        slim = slim.withColumn("_q", F.lit(None).cast("int"))
    slim = slim.withColumn("_key", sampling_key(F.col("doc_id"), sampling_weight(F.col("_q")), seed)).drop("_q")
    level = F.log(F.col("_key")) * COARSE
    slim = slim.withColumn("_coarse", F.floor(level).cast("int")).withColumn("_fine", F.least(F.floor((level - F.floor(level)) * FINE), F.lit(FINE - 1)).cast("int"))
    slim = shared_checkpoint(slim)
    goal = targets(slim, "source", weights, share, repeats).withColumnRenamed("source", "_source")
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_left", (F.round("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    goal = _end(slim, "_coarse", goal, F.lit(0), "1")
    inner = slim.join(goal, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_coarse") == F.col("_end1"))).select("source", "size", "_fine")
    goal = _end(inner, "_fine", goal, F.col("_before1"), "2")
    rows = slim.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.col("_epochs") * F.col("size")
    at_end = (F.col("_coarse") == F.col("_end1")) & (F.col("_fine") == F.col("_end2"))
    sooner = (F.col("_coarse") < F.col("_end1")) | ((F.col("_coarse") == F.col("_end1")) & (F.col("_fine") < F.col("_end2")))
    others = rows.where(F.col("_end2").isNull() | ~at_end).withColumn("taken", whole + F.when(sooner, F.col("size")).otherwise(0))
    sofar = F.sum("size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = rows.where(at_end).withColumn("_sofar", sofar)
    last = last.withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_before2") - F.col("_sofar"))))
    names = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return others.select(*names).unionByName(last.select(*names))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("source")
