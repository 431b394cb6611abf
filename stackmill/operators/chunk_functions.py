"""The chunkers as table functions of SQL: select * from spans, lateral recursive_chunks(text, 2000, 200)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from stackmill.operators.chunking import line_windows, split_recursive


class RecursiveChunks:
    """piece (from 0) and chunk of a text, split at the coarsest separators that suffice; none for null and blank texts."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text and text.strip(" "):
            yield from enumerate(split_recursive(text, size, overlap))


class LineWindows:
    """piece (from 0) and chunk of a text in windows of whole lines of at most `bytes`; none for null and empty texts."""

    def eval(self, text: str, limit: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text:
            yield from enumerate(line_windows(text.split("\n"), limit, overlap))


def register(spark: SparkSession) -> None:
    """Registers recursive_chunks and line_windows in a session."""
    for name, made in (("recursive_chunks", RecursiveChunks), ("line_windows", LineWindows)):
        spark.udtf.register(name, udtf(made, returnType="piece bigint, chunk string"))
