"""Tables on disk: partition-wise replacement of points, snapshots with a catalogue, stage outputs by key, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.operators.ingest import staged
from stackmill.operators.state import to_prune
from stackmill.sources.config import PipelineConfig


def write_collections(points: DataFrame, path: str) -> None:
    """Writes the points' collections, replacing just the partitions of collections that occur in `points`."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def put_outputs(rows: DataFrame, path: str, stage: str) -> None:
    """Appends stage outputs, partitioned by stage and by the first two characters of their cache_key."""
    rows.withColumns({"stage": F.lit(stage), "shard": F.substring("cache_key", 1, 2)}).write.mode("append").partitionBy("stage", "shard").parquet(path)


def missing(wanted: DataFrame, outputs: DataFrame) -> DataFrame:
    """The rows of `wanted` whose cache_key has no output yet."""
    return wanted.join(outputs.select("cache_key").distinct(), "cache_key", "left_anti")


def append_json(rows: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    """Appends rows to a log of JSON lines, without the columns that must not be kept (such as a query's text)."""
    rows.drop(*without).write.mode("append").json(path)


def snapshot(spark: SparkSession, points: str, store: str, collection: str, name: str, created: int) -> str:
    """Copies one collection of the table into the store and enters it into the catalogue; returns the snapshot's id."""
    snapshot_id = f"{collection}__{name}"
    spark.read.parquet(points).where(F.col("collection") == collection).write.mode("overwrite").parquet(f"{store}/data/{snapshot_id}")
    spark.createDataFrame([(snapshot_id, collection, created)], "snapshot_id string, collection string, created bigint").write.mode("append").parquet(f"{store}/catalogue")
    return snapshot_id


def snapshots(spark: SparkSession, store: str, collection: str | None = None) -> DataFrame:
    """The catalogue, or the part of one collection."""
    rows = spark.read.parquet(f"{store}/catalogue")
    return rows if collection is None else rows.where(F.col("collection") == collection)


def restore(spark: SparkSession, store: str, snapshot_id: str, points: str) -> None:
    """Puts a snapshot back in place of its collection in the table."""
    write_collections(spark.read.parquet(f"{store}/data/{snapshot_id}"), points)


def prunable(spark: SparkSession, store: str, keep: int) -> DataFrame:
    """Snapshots beyond the newest `keep` of each collection."""
    return to_prune(snapshots(spark, store), keep)


def run(spans: DataFrame, config: PipelineConfig, points: str, outcomes: str, done: DataFrame | None = None) -> None:
    """The whole pipeline over the spans of new sources: points written by collection, outcomes appended."""
    made, told = staged(spans, config, done)
    made.write.mode("append").partitionBy("collection").parquet(points)
    append_json(told, outcomes)
