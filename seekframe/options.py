"""Settings of a search engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineOptions:
    k1: float = 1.2
    b: float = 0.75
    boosts: dict = field(default_factory=lambda: {"title": 3.0, "body": 1.0, "tags": 2.0})
    rrf_k: int = 60
    #: Weights of the lexical, semantic and vector lists; missing ones count 1.
    fusion: tuple = (1.0, 0.5, 6.0)
    #: Documents of each ranked list that fusion, phrases and paging see.
    pool: int = 200
    stopwords: bool = False
    mining: bool = True
    thesaurus: dict = field(default_factory=lambda: {"top_k": 8, "min_co": 2, "min_cosine": 0.08})
    expansion: int = 12
    #: Word vectors are trained from so many body tokens on, or if forced.
    vector_tokens: int = 400_000
    force_vectors: bool = False
    dimension: int = 120
    #: exact, graph, or auto: graphs from so many vectors on.
    knn: str = "auto"
    graph_from: int = 50_000
    graph_ef: int = 64
    #: Changes that are laid over an index before it is built anew.
    layers: int = 16
    snippet_tokens: int = 24
    snippet_chars: int = 240
