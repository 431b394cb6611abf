"""Held-out evaluation texts inside training documents, found with an FM-index of each shard of the corpus."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.llm.fmindex import FMIndex
from stackmill.session import spread

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
ENTITY = re.compile(r"&(?:#[0-9]{1,20}(?![0-9])|#[xX][0-9A-Fa-f]{1,16}(?![0-9A-Fa-f])|[A-Za-z][A-Za-z0-9]*);?")
#: Words of the documents in one index, and characters of evaluation texts that one pass looks for.
SHARD, PASS = 1_000_000, 1 << 22


def decoded(text: str) -> tuple[str, list[int], list[int]]:
    """A text with its HTML entities decoded, and where each of its characters begins and ends in the original."""
    parts, first, last, at = [], [], [], 0

    def keep(a: int, b: int) -> None:
        parts.append(text[a:b])
        first.extend(range(a, b))
        last.extend(range(a + 1, b + 1))

    for m in ENTITY.finditer(text):
        meant = html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:])
        if meant is not None:  # an unknown name is no entity
            keep(at, m.start())
            parts.append(meant)
            first += [m.start()] * len(meant)
            last += [m.end()] * len(meant)
            at = m.end()
    keep(at, len(text))
    return "".join(parts), first, last


def words_of(text: str) -> list[tuple[str, int, int]]:
    """The words of a text without case, marks and tags and with entities decoded, each with its place in the text."""
    plain = TAG.sub(lambda m: " " * len(m[0]), text) if "<" in text else text
    if "&" not in plain:
        return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(plain)]
    plain, first, last = decoded(plain)
    return [(m[0].lower(), first[m.start()], last[m.end() - 1]) for m in WORD.finditer(plain)]


def alike(item: list[int], text: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from item[i] and text[j] on, in direction `step`, are the same."""
    run = 0
    while 0 <= i + run * step < len(item) and 0 <= j + run * step < len(text) and item[i + run * step] == text[j + run * step]:
        run += 1
    return run


def aligned(item: list[int], text: np.ndarray, i: int, j: int, apart: int) -> tuple[int, int, int, int]:
    """Around the alike words at item[i:] and text[j:], the widest alignment: its bounds in the item and in the text."""

    def extend(i: int, j: int, step: int, free: bool) -> tuple[int, int]:
        run = alike(item, text, i, j, step)
        best = (run, run)
        if free or run >= apart:  # a difference may follow
            a, b = i + run * step, j + run * step
            for x, y in ((1, 1), (1, 0), (0, 1)):
                p, q = a + x * step, b + y * step
                if 0 <= p < len(item) and 0 <= q < len(text) and 0 <= a < len(item) and item[p] == text[q]:
                    got = extend(p, q, step, False)
                    if got[0] + run + x > best[0]:
                        best = (got[0] + run + x, got[1] + run + y)
        return best

    right, left = extend(i, j, 1, True), extend(i - 1, j - 1, -1, True)
    return i - left[0], i + right[0], j - left[1], j + right[1]


def _search(batch: list[tuple], phrases: list[list[int]], seeds: np.ndarray, seed_of: np.ndarray, vocabulary: dict[str, int], least: int, seed: int) -> Iterator[tuple]:
    """(document, phrase, first and last character) for a shard of (document, text) pairs."""
    docs, parts, starts, total = [], [], [], 0
    for doc, text in batch:
        found = words_of(text)
        ids = np.fromiter((vocabulary.get(w, 1) for w, _, _ in found), dtype=np.int64, count=len(found))
        if len(ids) < seed or not (ids > 1).any():
            continue
        docs.append((doc, found, ids))
        starts.append(total)
        parts += [ids, np.zeros(1, dtype=np.int64)]
        total += len(ids) + 1
    if not docs:
        return
    index = FMIndex(np.concatenate(parts))
    lo, hi = index.ranges(seeds)
    hit = np.nonzero(hi > lo)[0]
    if not len(hit):
        return
    rows = np.concatenate([np.arange(lo[h], hi[h]) for h in hit])
    which = np.repeat(hit, (hi - lo)[hit])
    place = index.locate(rows)
    at = np.searchsorted(starts, place, side="right") - 1
    order = np.lexsort((place, at))
    covered: dict[tuple[int, int, int], int] = {}
    for k in order:
        d, j = int(at[k]), int(place[k] - starts[at[k]])
        doc, found, ids = docs[d]
        for p, i in seed_of[which[k]]:
            if covered.get((d, p, i - j), -1) >= j:
                continue
            a, b, x, y = aligned(phrases[p], ids, i, j, seed)
            covered[d, p, i - j] = y - seed
            if b - a >= least:
                yield doc, p, found[x][1], found[y - 1][2], b - a


def seeds_of(phrases: list[list[int]], seed: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Every different run of `seed` words of the phrases, and the (phrase, place) where each of them stands."""
    runs = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(ids, dtype=np.int64), seed) for ids in phrases])
    places = [(p, i) for p, ids in enumerate(phrases) for i in range(len(ids) - seed + 1)]
    seeds, which = np.unique(runs, axis=0, return_inverse=True)
    seed_of: list[list[tuple[int, int]]] = [[] for _ in seeds]
    for place, k in zip(places, which.ravel().tolist()):
        seed_of[k].append(place)
    return seeds, seed_of


def leaked(documents: DataFrame, items: DataFrame, least: int = 15, seed: int = 7, key: str = "doc_id", text: str = "text", item: str = "item_id", fields: tuple[str, ...] = ("q", "passage")) -> DataFrame:
    """Document, item, field, first and last character and number of the item's words, for each passage given away.

    A passage counts from `least` consecutive words of an item on. Case, marks, tags and HTML entities don't matter, and single words
    may be changed, added or dropped if at least `seed` unchanged ones stand between two of them; such a passage always
    holds `seed` unchanged words in a row, for which the index of each shard is searched. Null and empty texts give
    nothing on either side, repeated rows count once, and items with the same passage each get a row. The evaluation
    texts go to all tasks in passes of a bounded size; the documents are never collected.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.length(F.trim(text)) > 0)
    docs = spread(docs)
    sizes = items.agg(*[F.sum(F.length(f)).alias(f) for f in fields]).first()
    passes = 1 + sum(x or 0 for x in sizes) // PASS
    schema = "doc bigint, item bigint, field string, first bigint, last bigint, words bigint"
    found = []
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64(item), F.lit(passes)) == k)
        told: dict[tuple[str, ...], set] = {}
        for r in part.select(item, *fields).distinct().collect():  # at most about PASS characters
            for f in fields:
                ws = tuple(w for w, _, _ in words_of(r[f] or ""))
                if len(ws) >= least and r[item] is not None:
                    told.setdefault(ws, set()).add((r[item], f))
        vocabulary = {w: n + 2 for n, w in enumerate(sorted({w for ws in told for w in ws}))}
        phrases = [[vocabulary[w] for w in ws] for ws in sorted(told)]
        owners = [sorted(told[ws]) for ws in sorted(told)]
        if not phrases:
            continue
        sent = spark.sparkContext.broadcast((phrases, owners, vocabulary))

        def work(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            phrases, owners, vocabulary = sent.value
            seeds, seed_of = seeds_of(phrases, seed)

            def shard(rows: list[tuple]) -> pd.DataFrame:
                got = [(d, i, f, a, b, n) for d, p, a, b, n in _search(rows, phrases, seeds, seed_of, vocabulary, least, seed) for i, f in owners[p]]
                return pd.DataFrame(got, columns=["doc", "item", "field", "first", "last", "words"])

            rows, size = [], 0
            for pdf in batches:
                for row in zip(pdf["doc"], pdf["text"]):
                    rows.append(row)
                    size += len(row[1])
                    if size >= 6 * SHARD:
                        yield shard(rows)
                        rows, size = [], 0
            if rows:
                yield shard(rows)

        found.append(docs.mapInPandas(work, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def removal_spans(passages: DataFrame) -> DataFrame:
    """The spans to cut from each document: overlapping and touching passages merged. Columns doc, first, last."""
    w = Window.partitionBy("doc").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = passages.select("doc", "first", "last").distinct().withColumn("new", (before.isNull() | (F.col("first") > before)).cast("int"))
    return marked.withColumn("span", F.sum("new").over(w)).groupBy("doc", "span").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("span")
