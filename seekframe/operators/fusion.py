"""Fusion of ranked lists and of score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reciprocal_rank(lists: list[DataFrame], weights=None, k: int = 60) -> DataFrame:
    """(doc_id, score): sum of weight / (k + rank + 1) over lists (doc_id, rank from 0); missing weights are 1."""
    given = [*(weights or ()), *[1.0] * len(lists)]
    every = None
    for one, w in zip(lists, given):
        part = one.select("doc_id", (F.lit(float(w)) / (F.lit(k + 1) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("doc_id").agg(F.sum("s").alias("score"))


def weighted(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, score): alpha of a's scores and 1 - alpha of b's, both scaled to 0..1 (1 where all are equal)."""

    def scaled(x: DataFrame, w: float) -> DataFrame:
        ends = x.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # one row
        value = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        return x.join(F.broadcast(ends)).select("doc_id", (F.lit(float(w)) * value).alias("s"))

    return scaled(a, alpha).unionByName(scaled(b, 1 - alpha)).groupBy("doc_id").agg(F.sum("s").alias("score"))
