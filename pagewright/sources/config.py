"""Settings from a YAML file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Embedding:
    model: str = "words-64"
    dim: int = 64
    batch: int = 32
    instruction: str = ""
    num_ctx: int = 1024


@dataclass(frozen=True)
class Retrieval:
    mode: str = "vector"
    top_k: int = 5
    vector_weight: float = 1.0
    fts_weight: float = 1.0
    rare_slots: int = 2
    min_score: float | None = None
    relative_cutoff: float | None = None


@dataclass(frozen=True)
class Generation:
    model: str = "first-sentences"
    num_ctx: int = 8192
    think: bool = False


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 1600
    min_chars: int = 200
    overlap_sentences: int = 1


@dataclass(frozen=True)
class Config:
    paths: dict[str, str] = field(default_factory=dict)
    embedding: Embedding = Embedding()
    retrieval: Retrieval = Retrieval()
    generation: Generation = Generation()
    chunking: Chunking = Chunking()


def load(path: str, fallback: str | None = None) -> Config:
    """The settings of a file, or of ``fallback`` where it is missing; unknown keys are errors.

    ``${data_root}`` and ~ are filled in in paths; the environment's
    PAGEWRIGHT_DATA takes the place of data_root.
    """
    import yaml

    with open(path if os.path.exists(path) or not fallback else fallback, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    paths = dict(raw.pop("paths", None) or {})
    root = os.path.expanduser(os.environ.get("PAGEWRIGHT_DATA") or paths.get("data_root", "."))
    paths = {k: os.path.expanduser(str(v).replace("${data_root}", root)) for k, v in paths.items()} | {"data_root": root}
    parts = {f.name: type(f.default) for f in fields(Config) if f.name != "paths"}
    if unknown := set(raw) - set(parts):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(paths=paths, **{name: kind(**(raw.get(name) or {})) for name, kind in parts.items()})
