"""Queries for the problems of training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.encoding import reread
from stackmill.llm.leaks import leaked, removal_spans
from stackmill.llm.neighbours import nearest, pairs_of
from stackmill.llm.packing import packed
from stackmill.llm.prose import with_quality
from stackmill.llm.scans import noise, paragraphs
from stackmill.llm.splitting import pieces
from stackmill.llm.subjects import assign
from stackmill.session import table


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "text_spans").select(F.lit("text_spans").alias("tab"), F.col("span_id").alias("rec_id"), "text", (F.col("kind") == "Code").alias("code"))
    hits = table(spark, sf_dir, "hits").select(F.lit("hits").alias("tab"), F.col("hit_id").alias("rec_id"), "text", (F.col("content_type") == "code").alias("code"))
    return with_quality(spans.unionByName(hits), excluded=F.col("code"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).where("not_prose").select("tab", "rec_id").distinct()


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).drop("text", "code").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(nearest(table(spark, sf_dir, "points")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "rcts_cases")).where("oversized and piece_no = 0").select("case_id", "finest")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "rcts_cases")).select("case_id", "piece_no", "start", "text", "cut")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(table(spark, sf_dir, "text_spans"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "text_spans"))


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reread(table(spark, sf_dir, "text_spans").select("span_id", "text")).where("affected")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir).select("span_id", "restored", "chain", "lost").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir).select("span_id").distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = removal_spans(leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))
    return spans.select(F.col("doc").alias("doc_id"), "first", "last")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))
    return found.select("doc_id", "subject")


QUERIES = {"p1_found": p1_found, "p1_statistics": p1_statistics, "p2_found": p2_found, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_packed": p6_packed, "p7_found": p7_found, "p7_removal_spans": p7_removal_spans, "p8_found": p8_found}
SQL = {
    "p5_found": r"""
with cases as (select distinct case_id, chunk_size, regexp_replace(text, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g') as t
               from rcts_cases where text is not null and chunk_size >= 1),
over as (select * from cases where length(t) > chunk_size),
parts as (select case_id, chunk_size,
    list_max(list_transform(regexp_split_to_array(t, '\n(?:[\t\r\f\x0b\p{Z}\x1c-\x1f\x85]*\n)+'), lambda x: length(regexp_replace(x, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g')))) as p,
    list_max(list_transform(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g')))) as l,
    list_max(list_transform(regexp_split_to_array(t, '[\s\p{Z}\x0b\x1c-\x1f\x85]+'), lambda x: length(x))) as w from over)
select case_id, case when p <= chunk_size then 'paragraph' when l <= chunk_size then 'line' when w <= chunk_size then 'word' else 'char' end as finest from parts""",
}
