"""Passages around search hits, read from the whole sources that the hits come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROBE = 160


def probe_of(text) -> F.Column:
    """Of a chunk's text without its first block (a heading): characters 200 to 360, of a short one the first 160."""
    cut = F.instr(text, "\n\n")
    body = F.when(cut > 0, F.substr(text, cut + 2)).otherwise(text)
    return F.when(F.length(body) > 380, F.substring(body, 201, PROBE)).otherwise(F.substring(body, 1, PROBE))


def _blocks(spans: DataFrame, around: int, block: int) -> DataFrame:
    """source_id, block, text and its place `at`: the sources' texts in blocks, each with what stands `around` it."""
    w = Window.partitionBy("source_id").orderBy("span_index", "span_id")
    placed = spans.where("text is not null").select("source_id", "span_index", "span_id", F.when(F.row_number().over(w) > 1, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")).alias("piece"))
    placed = placed.withColumn("end", F.sum(F.length("piece").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.length("piece"))
    after = around + PROBE
    lowest, highest = F.greatest(F.lit(0), F.floor((F.col("start") - after) / block)), F.ceil((F.col("end") + around) / block) - 1
    cut = placed.withColumn("block", F.explode(F.sequence(lowest, F.greatest(lowest, highest))))
    cut = cut.withColumn("from", F.greatest("start", F.col("block") * block - around)).withColumn("to", F.least("end", (F.col("block") + 1) * block + after))
    cut = cut.where("to >= from").select("source_id", "block", "from", F.substr("piece", (F.col("from") - F.col("start") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("part"))
    rows = cut.groupBy("source_id", "block").agg(F.sort_array(F.collect_list(F.struct("from", "part"))).alias("parts"))
    return rows.select("source_id", "block", F.array_join(F.col("parts.part"), "").alias("text"), F.col("parts")[0]["from"].alias("at"))


def expanded(hits: DataFrame, spans: DataFrame, around: int = 1500, block: int = 1 << 14) -> DataFrame:
    """hit_id, passage and `found`: the characters `around` the first place of the hit's probe in its source.

    A source is its spans' texts in the order of span_index, joined by newlines; the probe may reach over several spans.
    A hit whose probe is nowhere in its source keeps its own text. Null texts give no row, repeated rows count once. No
    row holds more of a source than one block: probes meet the blocks of their source that hold three of their words in
    a row; only those without four blanks meet all of them.
    """
    asked = hits.where("text is not null").select("hit_id", "source_id", "text").distinct().withColumn("probe", probe_of(F.col("text")))
    probes = asked.where((F.col("probe") != "") & F.col("source_id").isNotNull()).select("source_id", "probe").distinct()
    blocks = _blocks(spans.select("source_id", "span_index", "span_id", "text").distinct().join(probes.select("source_id").distinct(), "source_id", "left_semi"), around, block)
    words = F.split("text", r"\s+")
    three = lambda ws, i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i, 3)))
    held = blocks.select("source_id", "block", words.alias("words")).where(F.size("words") >= 3)
    held = held.select("source_id", "block", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: three(F.col("words"), i)))).alias("key"))
    parts = F.split("probe", r"\s+")  # the first and the last may be parts of words
    keyed = probes.where(F.size(parts) >= 5).withColumn("key", three(parts, F.lit(2))).join(held, ["source_id", "key"]).select("source_id", "probe", "block")
    others = probes.where(F.size(parts) < 5).join(blocks.select("source_id", "block"), "source_id").select("source_id", "probe", "block")
    met = keyed.unionByName(others).join(blocks, ["source_id", "block"])
    met = met.withColumn("place", F.expr(f"locate(probe, text, cast(block * {block} - at + 1 as int))")).withColumn("offset", F.col("at") + F.col("place") - 1)
    met = met.where((F.col("place") > 0) & (F.col("offset") < (F.col("block") + 1) * block))
    left = F.greatest(F.lit(1), F.col("place") - around)
    best = met.groupBy("source_id", "probe").agg(F.min_by(F.substr("text", left, F.col("place") + F.length("probe") + around - left), "offset").alias("passage"))
    return asked.join(best, ["source_id", "probe"], "left").select("hit_id", F.coalesce("passage", "text").alias("passage"), F.col("passage").isNotNull().alias("found"))
