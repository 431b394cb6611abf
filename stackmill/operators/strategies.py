"""Ways to ask more than once: the results of rewritten queries put together, one row of results a query and key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands before a query in a list of them.
BULLETS = "-•123456789. "


def rewritten(queries: DataFrame, rewriter: Callable[[str], str], key: str, text: str = "q", most: int = 3) -> DataFrame:
    """key, sub (from 0) and query of what an injected rewriter makes of each query, at most `most` lines of its answer.

    The query itself stands where the rewriter fails or says nothing; null queries give no row.
    """
    kind = queries.schema[key].dataType.simpleString()

    def lines(q: str) -> list[str]:
        try:
            said = rewriter(q)
        except Exception:  # noqa: BLE001  a query that cannot be rewritten is asked as it is
            said = ""
        return [s.strip(BULLETS) for s in (said or "").splitlines() if s.strip(BULLETS)][:most] or [q]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, n, s) for k, q in zip(pdf[key], pdf[text]) for n, s in enumerate(lines(q))], columns=[key, "sub", "query"])

    return queries.where(F.col(text).isNotNull()).select(key, text).mapInPandas(work, f"`{key}` {kind}, sub bigint, query string")


def decomposed(hits: DataFrame, query: str, keys: list[str], sub: str = "sub", rank: str = "rank_no", most: int = 14) -> DataFrame:
    """The hits of the parts of a question, one part after the other, each key once; the first `most` of each query, with `place`."""
    first = hits.groupBy(query, *keys).agg(F.min(F.struct(sub, rank)).alias("__at"))
    w = Window.partitionBy(query).orderBy("__at", *keys)
    return first.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).select(query, *keys, "place")


def iterative(first: DataFrame, second: DataFrame, labels: DataFrame, query: str, keys: list[str], rank: str = "rank_no", most: int = 14) -> DataFrame:
    """The first hits, and where their label isn't strong those of a second search that are new, up to `most` in all."""
    weak = labels.where(F.col("label") != "strong").select(query)
    more = second.join(weak, query, "left_semi")
    both = first.select(query, *keys, F.lit(0).alias("sub"), F.col(rank).alias("rank_no")).unionByName(more.select(query, *keys, F.lit(1).alias("sub"), F.col(rank).alias("rank_no")))
    return decomposed(both, query, keys, most=most)
