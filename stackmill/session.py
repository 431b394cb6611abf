"""Session helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for a stage of heavy Python work: the session's shuffle setting, and never fewer than two a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` over enough tasks for heavy work: as its input is split, and moved only where that gives fewer tasks than cores.

    With columns `by`, moved rows go by them and are put in their order, so that the order of rows is the same each time.
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    moved = df.repartition(tasks(df.sparkSession), *by)
    return moved.sortWithinPartitions(*by) if by else moved
