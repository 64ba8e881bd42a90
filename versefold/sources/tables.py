"""Tables of a folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes to a task from which a table of fewer partitions than the cluster has cores is dealt out before it is worked on.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to as many tasks as there are cores, where its files give fewer and each has much to do.

    A file of one row group is one task, whatever cores there are. Large tables have more partitions than cores and stay as they are.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    parts = plan.toRdd().getNumPartitions()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < parts < cores and size >= SPREAD_BYTES * parts else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
