"""Adding sources behind two gates: quality before anything is written, and retrieval health after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.operators import state
from stackmill.operators.evaluation import regression


def added(existing: DataFrame, batch: DataFrame, quality: DataFrame, history: DataFrame, after: DataFrame, threshold: float, force: bool = False, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(points, decisions) of adding the sources of a batch.

    Gate 1 refuses a source whose quality `value` is above the threshold; a source without a value passes. Gate 2 compares
    `after`, one row of health measured with the batch in place, with the history of runs: a regression rolls the whole
    batch back. With fewer than two runs, or without a row in `after`, there is nothing to compare with and the gate is
    open. `force` writes in spite of both. Decisions have one row a source: gate1, regressed (the metric or null) and
    action, one of refused, rolled_back, forced and committed.
    """
    signal = quality.groupBy(key).agg(F.max("value").alias("value"))
    verdict = batch.select(key).distinct().join(signal, key, "left").withColumn("gate1", F.coalesce(F.col("value") <= threshold, F.lit(True)))
    worse = regression(history, after).agg(F.max("regressed").alias("regressed"))  # one row
    told = verdict.crossJoin(F.broadcast(worse))
    bad = ~F.col("gate1") | F.col("regressed").isNotNull()
    action = F.when(F.lit(force) & bad, "forced").when(~F.col("gate1"), "refused").when(F.col("regressed").isNotNull(), "rolled_back").otherwise("committed")
    decisions = told.select(key, "gate1", "regressed", action.alias("action"))
    written = decisions.where(F.col("action").isin("forced", "committed")).select(key)
    return state.replaced(existing, batch.join(written, key, "left_semi"), key), decisions


def progress(outcomes: DataFrame, by: str = "source_id") -> DataFrame:
    """One line for each source, as a command would print it: ok, skip or fail, its stages and its error, parted by tabs."""
    status = F.when(F.bool_or(F.col("status") == "failed"), "fail").when(F.bool_or(F.col("status") == "skipped"), "skip").otherwise("ok")
    stages = F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "stage", "status"))), "\t")
    return outcomes.groupBy(by).agg(F.concat_ws("\t", status, F.concat(F.lit("source="), F.first(by)), stages, F.concat(F.lit("error="), F.max("error"))).alias("line"))
