"""Identities and hashes of sources, chunks, points and cached stage outputs, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of point ids.
POINT_NAMESPACE = "c011ec70-71be-40a1-9510-d0ead0706e73"


@dataclass(frozen=True)
class StageIdentity:
    """Name, version and configuration of a stage; what it has made is reused as long as all three stay the same."""

    name: str
    version: str
    config: str = "default"

    def folded(self, other: Column) -> Column:
        """This stage's configuration with the key of the stage before it, so that a change there makes new keys here."""
        return F.concat(F.lit(f"{self.config};chunks="), other)


# The stages' identities.
TEXT, CODE = StageIdentity("extractor-text", "0.1.0"), StageIdentity("extractor-code", "0.1.0")
STUB = StageIdentity("embedder-stub", "0.1.0", "dim=32")


def recursive_stage(size: int = 2000, overlap: int = 200) -> StageIdentity:
    return StageIdentity("chunker-recursive", "0.1.0", f"chunk_size={size};overlap={overlap}")


def source_hash(content: Column) -> Column:
    """sha256 of the bytes, in hex; null for null."""
    return F.sha2(content, 256)


def chunk_id(source_id: Column, chunk_index: Column) -> Column:
    return F.concat(source_id, F.lit("#"), chunk_index.cast("string"))


def cache_key(source_hash: Column, stage: StageIdentity, config: Column | None = None) -> Column:
    """sha256 over the four parts with a separator that none of them holds; null if a part is null."""
    parts = [source_hash, F.lit(stage.name), F.lit(stage.version), F.lit(stage.config) if config is None else config]
    whole = parts[0]
    for p in parts[1:]:
        whole = F.concat(whole, F.char(F.lit(31)), p)  # concat is null if a part is, concat_ws would drop it
    return F.sha2(whole, 256)


def point_id(source_id: Column, chunk_index: Column) -> Column:
    """The name-based UUID (version 5) of a chunk id in the points' namespace."""
    name = F.concat(F.unhex(F.lit(POINT_NAMESPACE.replace("-", ""))), F.encode(chunk_id(source_id, chunk_index), "UTF-8"))
    h = F.sha1(name)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def canonical_source_id(path: Column, root: str) -> Column:
    """The path below the corpus root; null outside of it ('/data/corpusX' is not below '/data/corpus')."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
