"""Configuration of a collection: a TOML file over defaults, and settings by flag, environment, file and default."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class PipelineConfig:
    collection: str = "default"
    content_type: str = "book"
    extractor: str = "text"
    chunker: str = "recursive"
    chunk_size: int = 2000
    chunk_overlap: int = 200
    corpus_root: str = "."
    garble_threshold: float = 1.0
    exclude: tuple[str, ...] = field(default=())
    keep: tuple[str, ...] = field(default=())
    retention: int = 5


def load(path: str) -> PipelineConfig:
    """The configuration in a TOML file; unknown keys are an error, absent ones have their default."""
    raw = tomllib.loads(Path(path).read_text())
    sections = raw.pop("sections", {})
    flat = raw | {k: tuple(v) for k, v in sections.items()}
    return PipelineConfig(**flat)


def setting(flag: str | None, env: str | None, file: str | None, default: str) -> str:
    """The first that is given: flag, environment, file, default."""
    return next(v for v in (flag, env, file, default) if v is not None)
