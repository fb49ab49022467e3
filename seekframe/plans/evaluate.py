"""Retrieval quality of an engine on labelled queries, and the report of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation
from .search import Engine

MEASURES = ("recall", "precision", "ndcg", "mrr", "hit_rate")


def results(engine: Engine, queries: DataFrame, k: int, modes=("bm25", "semantic", "hybrid")) -> DataFrame:
    """(query_id as mode/query, doc_id as ext_id, rank) of every query (query_id, query) in every mode.

    The queries are a labelled set, each searched on its own, as a user would.
    """
    rows = [(f"{mode}/{q['query_id']}", h["id"], h["rank"]) for mode in modes for q in queries.select("query_id", "query").collect() for h in engine.search(q["query"], mode, k, highlight=False).hits.select("id", "rank").collect()]
    return engine.spark.createDataFrame(rows, "query_id string, doc_id string, rank int")


def evaluate(engine: Engine, queries: DataFrame, k: int = 5, modes=("bm25", "semantic", "hybrid")) -> DataFrame:
    """(mode, kind, n, recall, precision, ndcg, mrr, hit_rate) of queries (query_id, query, relevant, kind); kind 'all' is
    all of them. Queries without relevant documents don't count."""
    ways = F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode")
    asked = queries.select(ways, "query_id", "relevant", "kind").select("mode", F.concat_ws("/", "mode", "query_id").alias("query_id"), "relevant", "kind")
    relevant = asked.select("query_id", F.explode("relevant").alias("doc_id"))
    found = evaluation.per_query(results(engine, queries, k, modes), relevant, asked, k).join(asked.select("query_id", "mode", F.explode(F.array(F.lit("all"), "kind")).alias("kind")), "query_id")
    return evaluation.averaged(found, "mode", "kind").orderBy("kind", "mode")


def report(measured: DataFrame, k: int, notes: str = "") -> str:
    """The measures as a Markdown table."""
    lines = [f"# Retrieval quality at {k}", *([notes] if notes else []), "", "| queries | mode | n | " + " | ".join(MEASURES) + " |", "|" + " --- |" * (len(MEASURES) + 3)]
    for r in measured.collect():
        lines.append(f"| {r['kind']} | {r['mode']} | {r['n']} | " + " | ".join(f"{r[m]:.3f}" for m in MEASURES) + " |")
    return "\n".join(lines) + "\n"
