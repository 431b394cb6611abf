"""Measures of retrieval: confidence of a result, ranks of relevant hits, health of a collection, regression of its health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions.text import is_fragment

# Bounds of the confidence labels.
NO_ANSWER, STRONG, MARGIN, FRAGMENTS = 0.25, 0.40, 0.03, 0.40


def ranked(hits: DataFrame, query: str, score: str = "score", ties: tuple[str, ...] = ("source_id", "chunk_index")) -> DataFrame:
    """The hits with `rn`, their place in the result of their query."""
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), *ties)))


def confidence(hits: DataFrame, query: str = "probe_id", rank: str = "rn", queries: DataFrame | None = None) -> DataFrame:
    """One row a query: top_score, margin to the second, score_spread, fragment_rate of the first five, value and label.

    With `queries`, each of them has a row; without a hit its numbers are 0 and its label is likely_no_answer.
    """
    score = F.col("score").cast("double")
    rows = hits.withColumn("frag", F.coalesce(is_fragment(F.col("text")), F.lit(True)).cast("double"))
    out = rows.groupBy(query).agg(
        F.max(F.when(F.col(rank) == 1, score)).alias("top_score"), F.max(F.when(F.col(rank) == 2, score)).alias("second"), F.stddev_pop(score).alias("score_spread"),
        F.avg(F.when(F.col(rank) <= 5, F.col("frag"))).alias("fragment_rate"))
    out = out.withColumn("margin", F.coalesce(F.col("top_score") - F.col("second"), F.lit(0.0))).drop("second")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top_score") * (1 - 0.5 * F.col("fragment_rate"))))
    label = F.when(F.col("top_score") < NO_ANSWER, "likely_no_answer").when((F.col("top_score") >= STRONG) & (F.col("margin") >= MARGIN) & (F.col("fragment_rate") <= FRAGMENTS), "strong").otherwise("weak")
    out = out.withColumns({"value": value, "label": label})
    if queries is None:
        return out
    return queries.select(query).distinct().join(out, query, "left").na.fill(0.0, ["top_score", "score_spread", "fragment_rate", "margin", "value"]).na.fill("likely_no_answer", ["label"])


def contains_any(text: Column, parts: Column) -> Column:
    """True if the text holds one of the parts, whatever their case; an empty part is in every text."""
    return F.exists(parts, lambda p: F.contains(F.lower(text), F.lower(p)))


def first_relevant(hits: DataFrame, query: str = "probe_id", rank: str = "rn", relevant: str = "relevant_hit") -> DataFrame:
    """Rank of the first relevant hit of each query, null without one, with its fragment rate and top score."""
    return hits.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first_rank"), F.avg(F.when(F.col(rank) <= 5, F.coalesce(is_fragment(F.col("text")), F.lit(True)).cast("double"))).alias("frag"),
                                   F.max(F.when(F.col(rank) == 1, F.col("score").cast("double"))).alias("top"))


def health(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, hit_rate, mrr (0 for a miss), fragment_rate and mean_top_score; zeros without a query."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query.groupBy(*(by or [])).agg(F.count("*").alias("n"), mean(F.col("first_rank").isNotNull().cast("double")).alias("hit_rate"), mean(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
                                              mean("frag").alias("fragment_rate"), mean("top").alias("mean_top_score"))


def regression(history: DataFrame, candidate: DataFrame, sigmas: float = 2.0, floor: float = 0.01) -> DataFrame:
    """First metric of the candidate that is worse than the history by more than max(sigmas * population deviation, floor);
    null if none is, and with fewer than two rows of history. One row for each candidate."""
    base = history.agg(F.count("*").alias("runs"), *[f(m).alias(f"{m}_{n}") for m in ("hit_rate", "mrr", "fragment_rate") for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    rows = candidate.crossJoin(base)  # one row
    worse = {m: sign * (F.col(m) - F.col(f"{m}_mean")) > F.greatest(F.lit(sigmas) * F.col(f"{m}_dev"), F.lit(floor)) for m, sign in (("hit_rate", -1), ("mrr", -1), ("fragment_rate", 1))}
    first = F.coalesce(*[F.when(bad, F.lit(m)) for m, bad in worse.items()])
    return rows.withColumn("regressed", F.when(F.col("runs") >= 2, first))


def fused(lists: DataFrame, query: str, key: str, rank: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (constant + place), places counted from 0, the best k of each query."""
    out = lists.groupBy(query, key).agg(F.sum(F.lit(1.0) / (constant + F.col(rank) - 1)).alias("rrf"))
    w = Window.partitionBy(query).orderBy(F.desc(F.round("rrf", 12)), key)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def islands(windows: DataFrame, source: str = "source_id", start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching half-open windows of a source merged."""
    w = Window.partitionBy(source).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("__new", (before.isNull() | (F.col(start) > before)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(source, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def nearest_rank(rows: DataFrame, by: str, value: str, percents: list[int], width: float = 0.001) -> DataFrame:
    """Percentiles by nearest rank (place round(p / 100 * (n - 1)), halves to even) of each group; null values are left out.

    Values are counted in bins of `width` first; only the rows of the bins that hold a wanted place are put in order,
    so that no group is ever collected.
    """
    x = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"), F.floor(F.col(value) / width).alias("bin"))
    bins = x.groupBy("g", "bin").agg(F.count("*").alias("n"))
    upto = bins.withColumn("end", F.sum("n").over(Window.partitionBy("g").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    wanted = upto.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("place", F.bround(F.col("p") / 100.0 * (F.col("all") - 1), 0).cast("bigint"))
    wanted = wanted.where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n"))).select(F.col("g").alias("wg"), F.col("bin").alias("wbin"), "p", (F.col("place") - F.col("end") + F.col("n")).alias("inner"))
    held = x.join(wanted.select("wg", "wbin").distinct(), F.col("g").eqNullSafe(F.col("wg")) & (F.col("bin") == F.col("wbin")), "left_semi")
    held = held.withColumn("at", F.row_number().over(Window.partitionBy("g", "bin").orderBy("v")) - 1)
    found = held.join(wanted, F.col("g").eqNullSafe(F.col("wg")) & (F.col("bin") == F.col("wbin")) & (F.col("at") == F.col("inner")))
    return found.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def bootstrap_interval(values: DataFrame, by: list[str], value: str, row: str, draws: int = 800, seed: int = 17) -> DataFrame:
    """Mean and a 95 % interval by resampling: each row is drawn a Poisson(1) number of times in each replicate;
    replicates that draw none count not.

    The weights come from a hash of row, replicate and seed, so that the result doesn't depend on partitions, and each
    row only meets its replicates, never other rows: sums of weights are combined before the shuffle.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(row), F.col("rep")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight, below, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(12):  # the inverse of the Poisson distribution
        below += p
        weight = weight + (u > below).cast("int")
        p /= k + 1
    drawn = values.where(F.col(value).isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", weight)
    reps = drawn.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    bounds = reps.groupBy(*by).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(*by, F.try_element_at("ms", F.floor(0.025 * F.size("ms")).cast("int") + 1).alias("low"), F.try_element_at("ms", F.greatest(F.lit(1), F.floor(0.975 * F.size("ms")).cast("int"))).alias("high"))
    return values.groupBy(*by).agg(F.avg(value).alias("mean")).join(bounds, by, "left")
