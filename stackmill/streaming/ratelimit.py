"""A token bucket for each key: in batches as folds over the runs of a key between long pauses, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Times that a bucket could be filled within one block of time.
BLOCK_RUNS = 64


def refill(tokens: float, passed: float, capacity: float, per_second: float) -> tuple[float, bool, float]:
    """(tokens after the request, whether it is admitted, seconds to wait if not) of one request."""
    tokens = min(capacity, tokens + max(0.0, passed) * per_second)
    return (tokens - 1, True, 0.0) if tokens >= 1 else (tokens, False, (1 - tokens) / per_second)


def runs(requests: DataFrame, key: str, tie: str, full_after: float) -> DataFrame:
    """The requests (key, tie, us) with `run`, which grows by one after each pause of a key of `full_after` seconds or more.

    Time is cut into blocks, so that a key with very many requests is ordered in many tasks; only one row a key and block
    is put in order over all blocks.
    """
    rows = requests.withColumn("block", F.floor(F.col("us") / F.lit(BLOCK_RUNS * full_after * 1e6)).cast("bigint"))
    over = Window.partitionBy(key).orderBy("block")
    ends = rows.groupBy(key, "block").agg(F.max("us").alias("last")).select(key, "block", F.lag("last").over(over).alias("before"))
    within = Window.partitionBy(key, "block").orderBy("us", tie)
    gap = F.col("us") - F.coalesce(F.lag("us").over(within), "before")
    marked = rows.join(ends, [key, "block"]).withColumn("fresh", F.coalesce((gap >= full_after * 1e6).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("fresh").over(within))
    earlier = marked.groupBy(key, "block").agg(F.max("run").alias("n")).select(key, "block", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return marked.join(earlier, [key, "block"]).withColumn("run", F.col("run") + F.col("earlier")).select(key, tie, "us", "run")


def admitted(requests: DataFrame, key: str, ts: str, tie: str, capacity: float, per_second: float) -> DataFrame:
    """Each request with `admitted`, in the order of time and `tie` within its key; a bucket starts full.

    After a pause long enough to fill the bucket, whatever it held, the requests of a key no longer depend on those
    before: a key is folded run by run, in different tasks. A task keeps one bucket at a time and needs no memory for the
    requests of a run. Rows with a null key or time are left out.
    """
    rows = requests.select(key, tie, F.unix_micros(ts).alias("us")).where(f"{key} is not null and us is not null")
    rows = runs(rows, key, tie, capacity / per_second).repartition(key, "run").sortWithinPartitions(key, "run", "us", tie)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tokens, last = None, capacity, 0
        for pdf in batches:
            out = []
            for k, run, us in zip(pdf[key], pdf["run"], pdf["us"]):
                if (k, run) != held:
                    held, tokens, last = (k, run), capacity, us
                tokens, ok, _ = refill(tokens, (us - last) / 1e6, capacity, per_second)
                last = us
                out.append(ok)
            yield pdf.drop(columns=["us", "run"]).assign(admitted=out)

    kinds = dict(requests.dtypes)
    return rows.mapInPandas(work, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, admitted boolean")


def admitted_stream(requests: DataFrame, key: str, ts: str, capacity: float, per_second: float) -> DataFrame:
    """The same on a stream: key, ts (microseconds) and admitted; each key's bucket is kept as state between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        for pdf in batches:
            pdf = pdf.sort_values("us")
            out = []
            for us in pdf["us"]:
                tokens, ok, _ = refill(tokens, 0.0 if last is None else (us - last) / 1e6, capacity, per_second)
                last = int(us)
                out.append(ok)
            yield pd.DataFrame({"key": [name[0]] * len(pdf), "us": pdf["us"].to_numpy(), "admitted": out})
        state.update((tokens, last))

    rows = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, us bigint, admitted boolean", "tokens double, last bigint", "append", GroupStateTimeout.NoTimeout)
