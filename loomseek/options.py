"""Option records; wrong values raise ValueError when the record is made."""

from __future__ import annotations

import math
from dataclasses import dataclass

RRF_K = 60


def _whole(name: str, value: object, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


def _number(name: str, value: object, least: float | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or (least is not None and value < least):
        raise ValueError(f"{name} must be a finite number" + ("" if least is None else f" of at least {least:g}"))


@dataclass(frozen=True)
class ChunkOptions:
    chunk_size: int = 600
    chunk_overlap: int = 120
    title_prefix: bool = True

    def __post_init__(self) -> None:
        _whole("chunk_size", self.chunk_size, 1)
        _whole("chunk_overlap", self.chunk_overlap, 0)
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")


@dataclass(frozen=True)
class SearchOptions:
    """``score_digits``: decimals to which scores are rounded before they are compared (None: not at all)."""

    limit: int = 10
    min_score: float = 0.0
    specific_term_heuristic: bool = True
    score_digits: int | None = 9

    def __post_init__(self) -> None:
        _whole("limit", self.limit, 0)
        _number("min_score", self.min_score)
        if not isinstance(self.specific_term_heuristic, bool):
            raise ValueError("specific_term_heuristic must be true or false")


@dataclass(frozen=True)
class HybridOptions(SearchOptions):
    rrf_k: int = RRF_K
    semantic_weight: float = 1.0
    keyword_weight: float = 1.0

    def __post_init__(self) -> None:
        super().__post_init__()
        _whole("rrf_k", self.rrf_k, 1)
        _number("semantic_weight", self.semantic_weight, 0)
        _number("keyword_weight", self.keyword_weight, 0)


@dataclass(frozen=True)
class ToolArguments:
    """A query as tools pass it: trimmed and not empty, with a limit from 1 to 20."""

    query: str
    limit: int = 5

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", self.query.strip() if isinstance(self.query, str) else "")
        if not self.query:
            raise ValueError("query must not be empty")
        _whole("limit", self.limit, 1)
        if self.limit > 20:
            raise ValueError("limit must be at most 20")


@dataclass(frozen=True)
class SiteOptions:
    """Defaults for the index of a site: the width of vectors, how it is cut, which pages it has, and how it is searched."""

    dims: int = 128
    chunks: ChunkOptions = ChunkOptions()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    search: HybridOptions = HybridOptions(min_score=0.2)

    def __post_init__(self) -> None:
        _whole("dims", self.dims, 1)
