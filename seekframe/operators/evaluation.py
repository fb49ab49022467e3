"""Retrieval metrics with binary relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, ndcg, rr) of ranked (query_id, doc_id, rank from 0), relevant (query_id, doc_id) and
    all queries (query_id). recall and ndcg are null for a query without relevant documents; precision divides by the
    length of the list, up to k, and is 0 for an empty list."""
    rel = relevant.select("query_id", "doc_id").distinct()
    judged = ranked.join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return per_judged(judged, rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel")), queries, k)


def per_judged(hits: DataFrame, wanted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """per_query of judged lists (query_id, rank, hit 0 or 1) and numbers of relevant documents (query_id, n_rel), for
    relevance that follows from a property: its pairs need not be written out."""
    top = F.col("rank") < k
    sums = hits.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"),
        F.sum(F.when(top, 1).otherwise(0)).alias("listed"),
        F.sum(F.when(top, F.col("hit") / F.log2(F.col("rank") + 2.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    rows = queries.select("query_id").join(sums, "query_id", "left").join(wanted, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select(
        "query_id",
        (F.coalesce("hits", F.lit(0)) / F.col("n_rel")).alias("recall"),
        F.when(F.coalesce("listed", F.lit(0)) > 0, F.col("hits") / F.col("listed")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("n_rel") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 / (F.col("first") + 1.0), F.lit(0.0)).alias("rr"),
    )


def averaged(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over the queries that have relevant documents, by the given columns."""
    rows = metrics.filter("recall IS NOT NULL")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), mean("recall", "recall"), mean("precision", "precision"), mean("ndcg", "ndcg"), mean("rr", "mrr"), mean((F.col("recall") > 0).cast("double"), "hit_rate"))


def nearest_rank(values: DataFrame, column: str, *percents: float) -> DataFrame:
    """One row: the nearest-rank percentiles p<percent> of a column."""
    return values.select(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").alias(f"p{p:g}") for p in percents])
