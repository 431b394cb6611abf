"""Ingestion as one staged plan: section filter, signal, chunks, vectors and points; failures stay rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions import identity as ids
from stackmill.functions import text as t
from stackmill.operators import chunking, state
from stackmill.operators.search import stub_vector
from stackmill.sources.config import PipelineConfig


CHUNKERS = ("recursive", "blankline")


def chunked(spans: DataFrame, config: PipelineConfig) -> DataFrame:
    """source_id, chunk_index, page and text by the chunker that the configuration names; code always by windows of lines.

    An unknown chunker is an error before any work.
    """
    if config.chunker not in CHUNKERS:
        raise ValueError(f"unknown chunker {config.chunker!r} (one of {', '.join(CHUNKERS)})")
    if config.content_type == "code":
        at = spans.select("source_id", F.col("span_index").cast("bigint").alias("span_index"), F.col("page").cast("bigint").alias("page"), "text").withColumn("at", F.struct("source_id", "span_index", "page"))
        parts = chunking.code_windows(at, "at").select("at.*", F.col("chunk_index").alias("piece"), "text")
    elif config.chunker == "blankline":
        parts = chunking.blank_line_chunks(spans.withColumn("span_index", F.col("span_index").cast("bigint")))
        parts = parts.withColumn("piece", F.row_number().over(Window.partitionBy("source_id", "span_index").orderBy("block", "part")).cast("bigint") - 1)
        parts = parts.join(spans.select("source_id", F.col("span_index").cast("bigint").alias("span_index"), F.col("page").cast("bigint").alias("page")).distinct(), ["source_id", "span_index"])
    else:
        parts = chunking.recursive_chunks(spans, config.chunk_size, config.chunk_overlap)
    return chunking.with_chunk_index(parts).select("source_id", "chunk_index", "page", "text")


def payload(content_type: str, path: Column, page: Column) -> Column:
    """The tagged payload of a chunk as JSON: {"Book": {"title", "page"}}, {"Paper": {"title", "page_start", "page_end"}}
    or {"Code": {"file_path"}}; titles are the file's stem, and what is null is left out."""
    if content_type == "code":
        return F.to_json(F.struct(F.struct(path.alias("file_path")).alias("Code")))
    title = t.file_stem(path).alias("title")
    if content_type == "paper":
        return F.to_json(F.struct(F.struct(title, page.alias("page_start"), page.alias("page_end")).alias("Paper")))
    return F.to_json(F.struct(F.struct(title, page.alias("page")).alias("Book")))


def staged(spans: DataFrame, config: PipelineConfig, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, outcomes) of the spans of new sources.

    Sources whose section is excluded are skipped, sources in `done` (already ingested) do no work, and a source with
    a broken span fails without points while all others go on. Points carry the stub vector; another embedder can be
    put over their text. Outcomes have source_id, stage, status and error, one row a source and stage.
    """
    if done is not None:
        spans = spans.join(done.select("source_id").distinct(), "source_id", "left_anti")
    reason = t.section_reason(t.file_stem(F.col("source_id")), list(config.exclude), list(config.keep))
    error = F.col("error") if "error" in spans.columns else F.when(F.col("text").isNull(), F.lit("no text"))
    whole = spans.groupBy("source_id").agg(F.max(error).alias("error"), F.sum(F.length("text")).alias("chars"), F.sum(t.replacement_marks(F.col("text")) + t.letterspace_runs(F.col("text"))).alias("marks"))
    whole = whole.withColumn("reason", reason).withColumn("error", F.coalesce("error", F.when(F.coalesce("chars", F.lit(0)) == 0, "empty extract")))
    good = whole.where("reason is null and error is null").select("source_id")
    kept = spans.join(good, "source_id", "left_semi")
    chunks = chunked(kept, config)
    points = chunks.select(ids.point_id(F.col("source_id"), F.col("chunk_index")).alias("point_id"), F.lit(config.collection).alias("collection"), "source_id", "chunk_index",
                           F.lit(config.content_type).alias("content_type"), "text", payload(config.content_type, F.col("source_id"), F.col("page")).alias("payload_json"), F.transform(stub_vector(F.col("text")), lambda x: x.cast("float")).alias("vector"))
    flagged = F.col("marks") * 1000.0 / F.greatest(F.col("chars"), F.lit(1)) > config.garble_threshold
    entry = lambda stage, status, message: F.struct(F.lit(stage).alias("stage"), status.alias("status"), message.cast("string").alias("error"))
    none = F.lit(None)
    stages = (F.when(F.col("reason").isNotNull(), F.array(entry("section", F.lit("skipped"), F.col("reason"))))
              .when(F.col("error").isNotNull(), F.array(entry("extract", F.lit("failed"), F.col("error"))))
              .otherwise(F.array(entry("extract", F.lit("success"), none), entry("quality", F.when(flagged, "flagged").otherwise("success"), none), *[entry(s, F.lit("success"), none) for s in ("chunk", "embed", "index")])))
    return points, whole.select("source_id", F.explode(stages).alias("e")).select("source_id", "e.stage", "e.status", "e.error")


def removed(points: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points without those of the sources, outcomes 'removed' of their four stages); the quality entry stays as it is."""
    gone = sources.select("source_id").distinct()
    stages = F.explode(F.array(*map(F.lit, ("extract", "chunk", "embed", "index"))))
    return state.deleted(points, gone), gone.select("source_id", stages.alias("stage"), F.lit("removed").alias("status"), F.lit(None).cast("string").alias("error"))
