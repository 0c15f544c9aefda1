"""Settings with their defaults and the invariants that hold between them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Chunking:
    size: int = 4000
    overlap: int = 500
    least: int = 10  # segments need more characters than this

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("the overlap must be less than the chunk size")


@dataclass(frozen=True)
class Retrieval:
    """Candidates of the vector search, size of the fused pool, and results; steps that refine the pool."""

    nearest: int = 50
    pool: int = 50
    final: int = 15
    containment: bool = False
    shingle: int = 3
    containment_threshold: float = 0.95
    cosine_dedup: bool = False
    cosine_threshold: float = 0.95
    diversify: bool = False
    relevance_weight: float = 0.5

    def __post_init__(self) -> None:
        if not self.nearest >= self.pool >= self.final >= 1:
            raise ValueError("needs nearest >= pool >= final >= 1")
        if not 0 <= self.relevance_weight <= 1:
            raise ValueError("the relevance weight lies between 0 and 1")


EMBEDDING_BATCH = 2048


def setting(name: str, default: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """A setting from the environment; a blank one counts as unset, and one without default must be set."""
    value = (os.environ if env is None else env).get(name, "")
    if value.strip():
        return value
    if default is None:
        raise KeyError(f"{name} is not set")
    return default


def int_setting(name: str, default: int | None = None, env: Mapping[str, str] | None = None) -> int:
    return int(setting(name, None if default is None else str(default), env))
