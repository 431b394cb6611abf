"""Chunkers: blank-line blocks and code windows as native expressions, recursive chunks with headings in Arrow batches."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.session import tasks

SEPARATORS = ("\n\n", "\n", " ", "")
HEADING = re.compile(r"(#{1,3})(?:\s+(.*))?$")


def packed_runs(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined up to `size`; each run begins with the last parts of the one before, up to `overlap`."""
    held: deque[str] = deque()
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held).strip()
            while total > overlap or (total and total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    yield "".join(held).strip()


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about `size` characters, cut at the coarsest separator that the text has, and finer where parts are too large."""
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    parts = list(text) if not sep else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    if sep and len(sep) > 1:  # a look-ahead would also cut inside of a run of separators
        head, *tail = text.split(sep)
        parts = [p for p in [head, *(sep + t for t in tail)] if p]
    out: list[str] = []
    for small, run in groupby(parts, key=lambda p: len(p) < size):
        if small:
            out += [c for c in packed_runs(list(run), size, overlap) if c]
        else:
            for part in run:
                out += split_recursive(part, size, overlap, finer) if finer else [part]
    return out


def sections(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(active headings, body) of a Markdown text; lines are trimmed, and headings inside code fences are none."""
    out: list[tuple[tuple[str, ...], list[str]]] = []
    active: list[tuple[int, str]] = []
    shown: tuple[str, ...] = ()
    block: list[str] = []
    fence = ""

    def close() -> None:
        if block:
            out.append((shown, ["\n".join(block)]))
            block.clear()

    for raw in text.split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence and not line.startswith(fence):
            block.append(line)
            continue
        if not fence and (line.startswith("~~~") or (line.startswith("```") and line.count("```") == 1)):
            fence = line[:3]
            block.append(line)
            continue
        fence = ""
        heading = HEADING.match(line)
        if heading:
            active = [*((n, t) for n, t in active if n < len(heading[1])), (len(heading[1]), (heading[2] or "").strip())]
            close()
        elif line:
            block.append(line)
        else:
            close()
        shown = tuple(t for _, t in active)
    close()
    return [(heads, "  \n".join(b for _, bodies in run for b in bodies)) for heads, run in groupby(out, key=lambda x: x[0])]


def crumb_of(file: str) -> str:
    stem = file.removesuffix(".md").split("__")
    book = stem[0].split("_", 1)[-1]
    return " > ".join([book, *stem[1:2]]).strip(" >")


def with_breadcrumbs(text: str, file: str | None, size: int, overlap: int) -> list[str]:
    """The chunks of a text, each led by the path of headings above it; the path is not counted in the size."""
    crumb = crumb_of(file) if file else ""
    parts = sections(text) or [((), text)]
    out = []
    for heads, body in parts:
        path = " > ".join(x for x in (crumb, *heads) if x)
        out += [f"{path}\n\n{c}" if path else c for c in split_recursive(body, size, overlap)]
    return out


def recursive_chunks(spans: DataFrame, size: int = 2000, overlap: int = 200, breadcrumbs: bool = False) -> DataFrame:
    """source_id, span_index, piece (from 0 in the span), page and text of each chunk of the spans.

    Null and blank texts give no chunk. `chunk_index` over a whole source is added by with_chunk_index, without moving
    the texts of a source into one task.
    """
    rows = spans.select("source_id", F.col("span_index").cast("bigint").alias("span_index"), F.col("page").cast("bigint").alias("page"), "text").where(F.length(F.trim("text")) > 0)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(s, i, n, p, c) for s, i, p, t in zip(pdf["source_id"], pdf["span_index"], pdf["page"], pdf["text"])
                   for n, c in enumerate(with_breadcrumbs(t, str(s).rsplit("/", 1)[-1], size, overlap) if breadcrumbs else split_recursive(t, size, overlap))]
            out = pd.DataFrame(got, columns=["source_id", "span_index", "piece", "page", "text"])
            out["page"] = out["page"].astype("Int64")
            yield out

    return rows.repartition(tasks(spans.sparkSession)).mapInPandas(work, "source_id string, span_index bigint, piece bigint, page bigint, text string")


def with_chunk_index(chunks: DataFrame) -> DataFrame:
    """chunk_index over each source, in the order of span_index and piece: counts of the pieces of the spans before."""
    from pyspark.sql import Window

    per_span = chunks.groupBy("source_id", "span_index").count()
    before = per_span.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("source_id").orderBy("span_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return chunks.join(before, ["source_id", "span_index"]).withColumn("chunk_index", F.col("before") + F.col("piece")).drop("before")


def blank_line_blocks(text: Column) -> Column:
    """Blocks between blank lines, trimmed, without empty ones: array<string>."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")


def line_windows(lines: list[str], limit: int, overlap: int) -> list[str]:
    """Windows of whole lines of at most `limit` bytes, each repeating the last `overlap` lines; a longer line stands alone."""
    size = [len(s.encode()) for s in lines]
    out, at = [], 0
    while at < len(lines):
        end, used = at + 1, size[at]
        while end < len(lines) and used + 1 + size[end] <= limit:
            used += 1 + size[end]
            end += 1
        out.append("\n".join(lines[at:end]))
        if end == len(lines):
            break
        at = max(at + 1, end - overlap)
    return out


def blank_line_chunks(spans: DataFrame, limit: int = 20_000, overlap: int = 5) -> DataFrame:
    """source_id, span_index, block (from 0) and text. Blocks over `limit` bytes are cut into windows of lines in Python;
    all others never leave the JVM. Null and blank texts give no chunk."""
    blocks = spans.select("source_id", "span_index", F.posexplode(blank_line_blocks(F.col("text"))).alias("block", "text"))
    small = blocks.where(F.octet_length("text") <= limit).withColumn("part", F.lit(0))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(s, i, b, w, n) for s, i, b, t in pdf.itertuples(index=False) for n, w in enumerate(line_windows(t.split("\n"), limit, overlap))], columns=["source_id", "span_index", "block", "text", "part"])

    large = blocks.where(F.octet_length("text") > limit).mapInPandas(work, "source_id string, span_index bigint, block int, text string, part int")
    return small.unionByName(large)


def code_windows(texts: DataFrame, key: str, text: str = "text", width: int = 30, overlap: int = 5) -> DataFrame:
    """Key, chunk_index and text of windows of lines, each starting `width - overlap` lines after the one before, until
    one reaches the end. Blank texts give none. Native expressions only."""
    stride = width - overlap
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    rows = texts.where(F.length(F.regexp_replace(text, r"(?U)\s", "")) > 0).select(key, lines.alias("lines"))
    count = F.greatest(F.lit(0), F.ceil((F.size("lines") - width) / stride).cast("int"))
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), count)))
    return rows.select(key, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.array_join(F.slice("lines", F.col("chunk_index") * stride + 1, width), "\n").alias("text"))
