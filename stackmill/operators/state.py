"""Keyed state on append-only tables: the newest row of each key, and points replaced, updated and deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INGESTED = ["success", "cached", "recovered_via_fallback"]


# What a stage may have come to.
STATUSES = ["pending", "success", "cached", "failed", "recovered_via_fallback", "skipped", "flagged", "removed"]


def parsed_status(status: Column) -> Column:
    """The status in its own spelling, whatever the case and the signs between words; null for any other."""
    plain = F.regexp_replace(F.regexp_replace(status, r"(?<=[a-z])(?=[A-Z])", "_"), r"[\s-]+", "_")
    return F.when(F.lower(plain).isin(STATUSES), F.lower(plain))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key by `order` (newest first); map tasks already drop all but one row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def manifest_view(log: DataFrame) -> DataFrame:
    """The last entry of each (source_id, stage): by updated_at, then attempts, then status, so that ties have one result."""
    return latest(log, ["source_id", "stage"], [F.desc("updated_at"), F.desc("attempts"), F.asc("status"), F.asc_nulls_first("error"), F.asc_nulls_first("output_ref")])


def upserted(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Both tables with one row for each key, that of `new` where both have it; no row of `new` changes nothing."""
    both = existing.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return latest(both, [key], [F.desc("__v")]).drop("__v")


def replaced(existing: DataFrame, batch: DataFrame, key: str = "source_id") -> DataFrame:
    """`existing` without all rows of the batch's sources, and the batch; chunks that the new version lacks are gone."""
    return deleted(existing, batch, key).unionByName(batch)


def deleted(existing: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """`existing` without the rows of the given sources; a source that has none changes nothing."""
    return existing.join(sources.select(key).distinct(), key, "left_anti").select(*existing.columns)


def named_slots(**slots: Column) -> Column:
    """A map from slot to vector; null and empty vectors leave their slot out."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in slots.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(F.size(e["value"]), F.lit(0)) > 0))


def wrong_slots(slots: Column, dims: dict[str, int]) -> Column:
    """The names of the slots that `dims` doesn't know, or whose vectors have another length; empty if all are right."""
    fits = lambda e: F.exists(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in dims.items()]), lambda k: (k["n"] == e["key"]) & (k["d"] == F.size(e["value"])))
    return F.array_sort(F.transform(F.filter(F.map_entries(slots), lambda e: ~fits(e)), lambda e: e["key"]))


def to_prune(snapshots: DataFrame, keep: int, part: str = "collection", name: str = "snapshot_id", created: str = "created") -> DataFrame:
    """The snapshots beyond the newest `keep` of each part; 0 keeps all."""
    if keep == 0:
        return snapshots.limit(0)
    w = Window.partitionBy(part).orderBy(F.desc(created), F.desc(name))
    return snapshots.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > keep).drop("__n")
