"""Seconds of an engine: its build by stages, and its answers."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame

from ..options import EngineOptions
from .search import Engine


def percentiles(values: list[float], *of: int) -> list[float]:
    """Nearest-rank percentiles; of no values, zeros."""
    ordered = sorted(values)
    return [ordered[max(0, math.ceil(p / 100 * len(ordered)) - 1)] if ordered else 0.0 for p in of]


def measure(docs: DataFrame, texts: list[str], options: EngineOptions = EngineOptions(), words=(), encoder=None, modes=("bm25", "hybrid"), repetitions: int = 3, top_k: int = 10) -> dict:
    """Builds an engine of docs with all its tables, then asks each text so often in each mode."""
    began = time.time()
    engine = Engine.build(docs, options, words, encoder)
    rows = {name: table.count() for name, table in engine.tables.items()}
    build = time.time() - began
    out = {"documents": rows["docs"], "postings": rows["postings"], "build_seconds": round(build, 3), "docs_per_second": round(rows["docs"] / build, 3), "stage_seconds": {k: round(v, 3) for k, v in engine.seconds.items()}, "mined_words": engine.mined, "latency_ms": {}}
    for mode in modes:
        took = []
        for text in texts * repetitions:
            at = time.time()
            engine.search(text, mode, top_k).hits.collect()
            took.append(1000 * (time.time() - at))
        out["latency_ms"][mode] = dict(zip(("p50", "p95", "max"), (round(x, 3) for x in percentiles(took, 50, 95, 100))))
    engine.close()
    return out
