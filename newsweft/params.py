"""Run parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    relevance_threshold: int = 6
    novelty_weight: float = 0.6
    relevance_weight: float = 0.4
    vector_weight: float = 0.5
    graph_weight: float = 0.5
    min_items: int = 5
    max_items: int = 10
    near_duplicate: float = 0.92
    related: float = 0.75
    dedup_days: int = 7
    briefed_dedup_days: int = 60
    max_chunk_tokens: int = 28000
    half_life_days: float = 14.0
    prune_below: float = 0.02
    neighbours: int = 5
    retrieval_k: int = 10
    max_retries: int = 3

    def __post_init__(self) -> None:
        for a, b in (("novelty_weight", "relevance_weight"), ("vector_weight", "graph_weight")):
            total = getattr(self, a) + getattr(self, b)
            if abs(total - 1.0) > 0.01:
                raise ValueError(f"{a} and {b} must add up to 1, got {total}")
        if not self.related < self.near_duplicate:
            raise ValueError("related must lie below near_duplicate")
        if self.min_items < 0 or self.max_items < 1:
            raise ValueError("min_items must be >= 0 and max_items >= 1")
