"""Typed settings with defaults, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    catalog: str = ""
    schema: str = "default"
    chunk_target: int = 220
    chunk_limit: int = 300
    chunk_overlap: int = 30
    top_k: int = 5
    score_threshold: float = 0.3
    graph_depth: int = 2
    alpha: float = 0.7
    cache_ttl: int = 300
    rate_limit: int = 30
    rate_gap: int = 60
    vector_dim: int = 3072
    metric: str = "cosine"
    fold_d_bar: bool = True

    def table(self, name: str) -> str:
        return ".".join(p for p in (self.catalog, self.schema, name) if p)


_TRUE = {"1", "true", "yes", "y", "on"}


def from_mapping(env: Mapping[str, str], prefix: str = "QUILLGRAPH_") -> Settings:
    """Blank values give the default; quotes around a value go; a bad number raises with its name."""
    found = {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper(), "").strip().strip("\"'").strip()
        if not raw:
            continue
        kind = type(f.default)
        try:
            found[f.name] = raw.lower() in _TRUE if kind is bool else kind(raw)
        except ValueError as error:
            raise ValueError(f"{prefix}{f.name.upper()}: {raw!r} is no {kind.__name__}") from error
    settings = Settings(**found)
    validate(settings)
    return settings


def validate(s: Settings) -> None:
    if not 0 < s.chunk_target <= s.chunk_limit or s.chunk_overlap < 0:
        raise ValueError("need 0 < chunk_target <= chunk_limit and chunk_overlap >= 0")
    if not 1 <= s.top_k <= 20 or not 0 <= s.alpha <= 1 or s.graph_depth < 1:
        raise ValueError("need 1 <= top_k <= 20, 0 <= alpha <= 1 and graph_depth >= 1")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value!r}")


def check_search(top_k: int = 5, alpha: float = 0.7, depth: int = 2, top_k_graph: int | None = None, question: str | None = None) -> None:
    """Bounds of a search request; raises with the field's name."""
    _within("top_k", top_k, 1, 20)
    _within("alpha", alpha, 0, 1)
    _within("depth", depth, 1, 10)
    if top_k_graph is not None:
        _within("top_k_graph", top_k_graph, 0, 20)
    if question is not None:
        _within("length of the question", len(question), 3, 2000)


def check_feedback(rating: int | None = None) -> None:
    if rating is not None:
        _within("rating", rating, 1, 5)


def check_page(limit: int, most: int = 100) -> None:
    _within("limit", limit, 1, most)
