"""Exact similarity search: one query natively, many queries by matrix products with a top k in each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass; a larger set of queries is taken in blocks of about this many, chosen by hash.
QUERIES_A_PASS = 4096


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine in double precision; 0 if a vector is all zero, null if the dimensions differ or a vector is null."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0)))


def search(points: DataFrame, query: list[float], k: int, content_type: str | None = None, vector: str = "vector", ties: tuple[str, ...] = ("source_id", "chunk_index")) -> DataFrame:
    """The k rows most similar to one query, best first; equal scores by `ties`. The filter comes before the top k.

    Rows with a null vector or another dimension are left out; an empty result is no error.
    """
    rows = points if content_type is None else points.where(F.col("content_type") == content_type)
    scored = rows.withColumn("score", cosine(F.col(vector), F.array(*map(F.lit, query)))).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), *ties).limit(k)


class NotFound(LookupError):
    """The collection that is asked for has no point."""


def search_points(points: DataFrame, collection: str, query: list[float], k: int, content_type: str | None = None, source_id: str | None = None, slot: str | None = None, vector: str = "vector") -> DataFrame:
    """The k points of a collection most similar to a query, best first; equal scores by source_id and chunk_index.

    Filters come before the top k. With `slot`, the vector is taken from the map column `vector` of named slots, and points
    without that slot are left out. An unknown collection raises NotFound, and a slot whose vectors have another dimension
    than the query a ValueError; no hit is no error. Null vectors are left out.
    """
    rows = points.where(F.col("collection") == collection)
    held = F.col(vector) if slot is None else F.col(vector)[slot]
    first = rows.select(F.size(held).alias("dim"), F.lit(1).alias("any")).agg(F.max("any").alias("any"), F.max(F.when(F.col("dim") == len(query), 1)).alias("fits"), F.max(F.when(F.col("dim") > 0, 1)).alias("some")).first()
    if first["any"] is None:
        raise NotFound(collection)
    if first["some"] is not None and first["fits"] is None:
        raise ValueError(f"no vector of {len(query)} numbers in {collection}" + (f", slot {slot}" if slot else ""))
    rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
    return search(rows.withColumn("__v", held), query, k, content_type, "__v").drop("__v")


def search_many(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, skip_self: bool = True) -> DataFrame:
    """query, key, score and rank of the k rows most similar to each query; equal scores by key.

    `queries` has the same columns as `rows`; keys keep their type, and a key counts once. Each pass broadcasts a block of
    about QUERIES_A_PASS query vectors, whose size is thereby bounded, and reads the rows once: tasks keep the best k for
    each query of their rows, so that no more than k rows a query and task are shuffled. More than one block are worked one
    after another, so that the driver holds one at a time. Null vectors, those with a null or without a number, and rows
    whose dimension is not the query's, are left out.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"query {kind}, key {kind}, score double"
    good = F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    usable = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(good)
    asked = queries.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(good)
    passes = 1 + asked.count() // QUERIES_A_PASS
    out = []
    for n in range(passes):
        block = asked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == n).toPandas().drop_duplicates("key")
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast([(part["key"].to_numpy(), _unit(part["v"])) for _, part in block.groupby(block["v"].map(len))])
        del block

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            held: dict[int, list[pd.DataFrame]] = {}
            for pdf in batches:
                for at, (ids, q) in enumerate(sent.value):
                    part = pdf[pdf["v"].map(len) == q.shape[1]]
                    if not len(part):
                        continue
                    keys = part["key"].to_numpy()
                    s = q @ _unit(part["v"]).T
                    if skip_self:
                        own = pd.Index(ids).get_indexer(keys)
                        s[own[own >= 0], np.nonzero(own >= 0)[0]] = -np.inf
                    m = min(k, s.shape[1])
                    least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                    i, j = np.nonzero((s >= least - 1e-12) & (s > -np.inf))  # with all that are equal to the last one
                    new = pd.DataFrame({"query": ids[i], "key": keys[j], "score": s[i, j]})
                    held[at] = [pd.concat([*held.get(at, []), new]).sort_values(["query", "score", "key"], ascending=[True, False, True]).groupby("query").head(k)]
            for parts in held.values():
                yield parts[0]

        found = usable.mapInPandas(best, schema)
        if passes > 1:
            found = found.persist(StorageLevel.MEMORY_AND_DISK)  # k rows a query and task
            found.count()
            sent.unpersist()
        out.append(found)
    if not out:
        return spark.createDataFrame([], schema + ", rank bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    found = found.groupBy("query", "key").agg(F.max("score").alias("score"))  # repeated rows
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype("f8")
    return x / np.where((norm := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, norm)


def stub_vector(text: Column, dim: int = 32) -> Column:
    """A vector that only depends on the text: the bytes of its sha256, over and over, from -1 to 1."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
