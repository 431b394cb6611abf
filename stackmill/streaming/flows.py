"""Streams: ingestion of new files, rollups of a log, the newest manifest rows, and drift of health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackmill.operators import ingest, state
from stackmill.sources.config import PipelineConfig

REQUEST = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def log_rollup(log: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Requests, mean time and failures by window, route and user; rows later than `late` are dropped by the watermark."""
    rows = log.withWatermark("ts", late).withColumn("user", F.coalesce(F.col("user_id").cast("string"), F.lit("anon")))
    return rows.groupBy(F.window("ts", width), F.col("event_type").alias("route"), "user").agg(F.count("*").alias("n"), F.avg("value").alias("mean_ms"), F.count_if(F.col("event_type") == "error").alias("failed"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: bounds and number of requests."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def ingest_stream(spans: DataFrame, points: str, outcomes: str, config: PipelineConfig, checkpoint: str) -> StreamingQuery:
    """Each batch of new spans runs the staged ingestion; sources that the outcomes already have do no work again."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = spark.read.parquet(outcomes).where("stage = 'index' and status = 'success'").where(F.col("batch") < number) if number else None
        made, log = ingest.staged(rows, config, done)
        made.withColumn("batch", F.lit(number)).write.mode("append").parquet(points)
        log.withColumn("batch", F.lit(number)).write.mode("append").parquet(outcomes)

    return spans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each (source_id, stage): every batch is merged with the view of the one before, and the
    new version is written beside it, so that a failed batch can be run again."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = spark.read.parquet(f"{path}/{number - 1}").unionByName(rows) if number else rows
        state.manifest_view(fresh).write.mode("overwrite").parquet(f"{path}/{number}")

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_stream(reports: DataFrame, path: str, checkpoint: str, judge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Each batch of health reports is judged against the history before it, and then added to the history."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number:
            judge(spark.read.parquet(f"{path}/history").where(F.col("batch") < number), rows).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/judged")
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/history")

    return reports.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, folder: str, schema: str = REQUEST, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(folder)
