"""Functions on judged answers, citations and generated text."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of an answer that declines.
DECLINES = ["don't know", "do not know", "cannot answer", "no information", "not covered"]


def letterspace_density(text: Column) -> Column:
    """Runs of single ASCII letters parted by one blank, by a thousand characters: a narrower rule than letterspace_runs."""
    return 1000.0 * F.regexp_count(text, F.lit(r"(?:\b[A-Za-z] ){3,}[A-Za-z]\b")) / F.greatest(F.length(text), F.lit(1))


def composite_garble(letterspace: Column, replacement: Column, latex: Column) -> Column:
    return letterspace + 1000.0 * replacement + F.least(latex, F.lit(5.0))


def gzip_ratio(text: Column) -> Column:
    """Compressed by plain size: very small for text that repeats itself; null for null and empty text."""

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(gzip.compress(t.encode(), mtime=0)) / len(t.encode()) if t else None).astype("float64")

    return ratio(text)


def cited(answer: Column) -> Column:
    """The different numbers cited as [n]."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1))


def citation_density(answer: Column) -> Column:
    """Citations by sentence end."""
    return F.regexp_count(answer, F.lit(r"\[\d+\]")) / F.greatest(F.regexp_count(answer, F.lit(r"[.!?]")), F.lit(1)).cast("double")


def declines(answer: Column) -> Column:
    """True if the first 160 characters say that there is no answer."""
    start = F.lower(F.substring(answer, 1, 160))
    out = F.lit(False)
    for phrase in DECLINES:
        out = out | start.contains(phrase)
    return out


def rest_url(url: Column) -> Column:
    """The REST address that belongs to a gRPC one: the same host, the port before."""
    return F.concat(F.regexp_extract(url, r"^(.*):\d+$", 1), F.lit(":"), (F.regexp_extract(url, r":(\d+)$", 1).cast("int") - 1).cast("string"))


def verbatim(quote: Column, passage: Column, words: int = 8) -> Column:
    """True if the first words of a quotation stand in the passage, case and marks aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.contains(plain(passage), F.array_join(F.slice(F.split(plain(quote), " "), 1, words), " "))


def quotations(answer: Column) -> Column:
    """array<struct(quote, n)>: what stands in straight quotes, 30 to 400 characters, right before or right after a [n]."""
    both = []
    for pattern, quote, n in ((r'"([^"]{30,400})"\s*\[(\d+)\]', 1, 2), (r'\[(\d+)\]\s*"([^"]{30,400})"', 2, 1)):
        both.append(F.arrays_zip(F.regexp_extract_all(answer, F.lit(pattern), F.lit(quote)).alias("quote"), F.regexp_extract_all(answer, F.lit(pattern), F.lit(n)).alias("n")))
    return F.concat(*both)
