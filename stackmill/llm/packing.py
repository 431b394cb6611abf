"""Documents packed into containers of fixed capacity: length patterns fitted by non-negative least squares.

Only the histogram of token counts, whose size is bounded by the capacity, is planned on: patterns of few lengths that
fill a container are enumerated, non-negative least squares fits how often to use each of them, the counts are rounded
down, and what is left is packed by patterns peeled off its own histogram. The plan says which ranks of each length go
to which containers, and Spark gives every document its rank, so that no document passes through the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.session import spread, tasks

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level tokenizer parts a text before it merges bytes.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Key and number of tokens of each document; null texts have none. The driver reads the tokenizer's file, of fixed
    size, and sends it along, so that no worker needs it in its own place; texts stay where they are."""
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")

    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return spread(rows).mapInPandas(work, "doc_id bigint, tokens bigint")


def triples(lengths: np.ndarray, capacity: int, most: int) -> Iterator[tuple[int, int]]:
    """The two smaller lengths of patterns of three, evenly picked so that about `most` pairs come out, and all if there are fewer."""
    first = np.arange(len(lengths))
    ends = np.searchsorted(lengths, (capacity - lengths) // 2, side="right")  # the second is at most half of what is left
    counts = np.maximum(0, ends - first)
    before = np.concatenate([[0], np.cumsum(counts)])
    picked = np.unique(np.linspace(0, before[-1] - 1, min(most, before[-1])).astype(np.int64)) if before[-1] else np.empty(0, dtype=np.int64)
    i = np.searchsorted(before, picked, side="right") - 1
    yield from zip(lengths[i].tolist(), lengths[i + picked - before[i]].tolist())


def patterns_for(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int = 4000, seed: int = 5) -> list[dict[int, int]]:
    """Patterns (length: how often) that fill a container, or nearly: all of one and two lengths and many of three, and
    longer ones filled by lengths drawn as frequent as they are and closed by the best fitting one.

    About `most` patterns of each kind are tried, whatever the capacity; lengths in no pattern are packed with the rest.
    """
    have = set(lengths.tolist())
    found: dict[tuple, dict[int, int]] = {}

    def add(parts: list[int]) -> None:
        p = dict(zip(*[x.tolist() for x in np.unique(parts, return_counts=True)]))
        found.setdefault(tuple(sorted(p.items())), p)

    for a in lengths.tolist():
        if a == capacity:
            add([a])
        elif capacity - a in have and a <= capacity - a:
            add([a, capacity - a])
    for a, b in triples(lengths, capacity, 4 * most):
        if capacity - a - b in have:
            add([a, b, capacity - a - b])
    rng = np.random.default_rng(seed)
    weight = counts / counts.sum()
    mean = max(1.0, float(lengths @ weight))
    for _ in range(most if mean * 3 < capacity else most // 4):
        left, parts = capacity, []
        for x in rng.choice(lengths, size=int(capacity / mean) + 2, p=weight).tolist():
            if x > left:
                break
            parts.append(x)
            left -= x
        if left and (k := int(np.searchsorted(lengths, left, side="right"))):
            parts.append(int(lengths[k - 1]))
        add(parts)
    return list(found.values())


def fitted(patterns: list[dict[int, int]], lengths: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: how often each pattern is used so that the lengths are used up."""
    row = {int(x): i for i, x in enumerate(lengths)}
    i = np.array([row[x] for p in patterns for x in p])
    j = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    a = np.array([n for p in patterns for n in p.values()], dtype="f8")
    w = lengths.astype("f8")[i]  # a token too many weighs the same in any length
    target = np.bincount(j, weights=a * w * counts[i] * w, minlength=len(patterns))
    x = np.full(len(patterns), counts.sum() / max(1.0, a.sum()))
    for _ in range(steps):
        now = np.bincount(i, weights=a * x[j], minlength=len(lengths))
        x *= target / np.maximum(np.bincount(j, weights=a * w * now[i] * w, minlength=len(patterns)), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first container, items of this length in a container) for a histogram
    of lengths from 1 to `capacity`. Its work depends on the number of different lengths, not on the counts."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    left = counts.copy()
    row = {int(x): i for i, x in enumerate(lengths)}
    uses: list[tuple[dict[int, int], int]] = []
    patterns = patterns_for(lengths, counts, capacity)
    if patterns:
        often = np.floor(fitted(patterns, lengths, counts.astype("f8")) + 1e-9).astype(np.int64)
        full = np.array([sum(x * n for x, n in p.items()) for p in patterns])
        for k in np.lexsort((-often, -full)):  # the fullest first, as often as the lengths still allow
            p = patterns[k]
            n = min(int(often[k]), *(int(left[row[x]] // m) for x, m in p.items()))
            if n > 0:
                uses.append((p, n))
                for x, m in p.items():
                    left[row[x]] -= n * m
    while left.any():  # a pattern from the largest length left, filled with the largest ones that fit
        room, p, at = capacity, {}, len(lengths) - 1
        while room:
            at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
            while at >= 0 and left[at] - p.get(int(lengths[at]), 0) <= 0:
                at -= 1
            if at < 0:
                break
            x = int(lengths[at])
            m = min(room // x, int(left[at]) - p.get(x, 0))
            p[x] = p.get(x, 0) + m
            room -= m * x
            at -= 1
        n = min(int(left[row[x]] // m) for x, m in p.items())
        uses.append((p, n))
        for x, m in p.items():
            left[row[x]] -= n * m
    out, used, container = [], dict.fromkeys(histogram, 0), 0
    for p, n in uses:
        for x, m in p.items():
            out.append((x, used[x], used[x] + n * m, container, m))
            used[x] += n * m
        container += n
    return out


def packed(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of each document or piece: profile, doc_id, piece (from 0), first_token, tokens, container (from 0).

    A document larger than a capacity is cut into pieces of that capacity and one rest; no other is split. Null and
    empty texts have no tokens and no container; a key that occurs more than once counts once, by its largest text.
    Profiles with a null capacity or one below 1 are left out; no document or no profile gives no row.
    """
    spark = documents.sparkSession
    sizes = token_counts(documents, key, text, tokenizer).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0").persist(StorageLevel.MEMORY_AND_DISK)
    profiles = {r["profile"]: r["capacity"] for r in limits.select("profile", "capacity").distinct().collect() if r["profile"] is not None and (r["capacity"] or 0) >= 1}
    parts = []
    for profile, capacity in sorted(profiles.items()):
        cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int")))).withColumn("piece", F.col("piece").cast("bigint"))
        parts.append(cut.select(F.lit(profile).alias("profile"), "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("bigint").alias("tokens")))
    schema = "profile string, doc_id bigint, piece bigint, first_token bigint, tokens bigint, container bigint"
    if not parts:
        return spark.createDataFrame([], schema)
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(64, tasks(spark)))))
    by_bucket = items.groupBy("profile", "tokens", "bucket").count()
    histograms: dict[str, dict[int, int]] = {p: {} for p in profiles}
    for r in by_bucket.groupBy("profile", "tokens").agg(F.sum("count").alias("n")).collect():  # at most as many rows as tokens fit
        histograms[r["profile"]][r["tokens"]] = r["n"]
    segments = {p: plan(h, profiles[p]) for p, h in histograms.items()}

    # the rank of each item among those of its length: within its bucket, and after the buckets before it
    before = by_bucket.withColumn("before", F.sum("count").over(Window.partitionBy("profile", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("profile", "tokens", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["profile", "tokens", "bucket"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before", "bucket")
    tables = {p: np.array(sorted(s), dtype=np.int64).reshape(-1, 5) for p, s in segments.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            container = np.zeros(len(pdf), dtype=np.int64)
            for p, at in pdf.groupby("profile", sort=False).indices.items():
                t = tables[p]
                width = np.int64(t[:, 2].max() + 1)
                length, rank = pdf["tokens"].to_numpy()[at], pdf["rank"].to_numpy()[at]
                k = np.searchsorted(t[:, 0] * width + t[:, 1], length * width + rank, side="right") - 1
                container[at] = t[k, 3] + (rank - t[k, 1]) // t[k, 4]
            yield pdf.drop(columns="rank").assign(container=container)[["profile", "doc_id", "piece", "first_token", "tokens", "container"]]

    return ranked.mapInPandas(place, schema)
