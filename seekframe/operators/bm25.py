"""Multi-field BM25 over index tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import latin_terms, let
from ..options import EngineOptions
from . import index as ix


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weights_of(terms: list[str] | dict[str, float]) -> dict[str, float]:
    """A term's weight is how often it stands in the query."""
    if isinstance(terms, dict):
        return terms
    return {t: float(terms.count(t)) for t in dict.fromkeys(terms)}


def scores(posts: DataFrame, lens: DataFrame, stats: DataFrame, terms: list[str] | dict[str, float], options: EngineOptions = EngineOptions()) -> DataFrame:
    """(doc_id, score), unordered. stats has one row a field and term frequencies one a query term: both are of fixed size
    and joined by broadcast; postings are filtered to the terms in their scan and meet lengths by (field, doc_id)."""
    wanted = weights_of(terms)
    if not wanted:
        return posts.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = posts.filter(F.col("term").isin(list(wanted)))
    df = ix.doc_freq(hits)
    boost, weight = F.lit(0.0), F.lit(0.0)
    for field, value in options.boosts.items():
        boost = F.when(F.col("field") == field, F.lit(float(value))).otherwise(boost)
    for term, value in wanted.items():
        weight = F.when(F.col("term") == term, F.lit(float(value))).otherwise(weight)
    rows = hits.select("field", "term", "doc_id", "tf").join(F.broadcast(df), "term").join(F.broadcast(stats), "field").join(lens, ["field", "doc_id"])
    norm = F.col("tf") + options.k1 * (1 - options.b + options.b * F.col("len") / F.col("avg_len"))
    value = weight * boost * idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (options.k1 + 1) / norm
    return rows.groupBy("doc_id").agg(F.sum(value).alias("score"))


def scanned(docs: DataFrame, queries: list[dict[str, float]], options: EngineOptions = EngineOptions()) -> DataFrame:
    """(doc_id, scores): one score a query (term -> weight) of every document (doc_id and the boosted fields), 0 without a
    term of it.

    For texts that no index holds: one pass counts lengths and frequencies into a single row, which is all the driver
    gets, and one scores each document within its row. Nothing else is shuffled. Han characters are boundaries.
    """
    terms = sorted(set().union(*queries))
    if not terms:
        return docs.select("doc_id", F.array(*[F.lit(0.0) for _ in queries]).alias("scores"))
    known = F.array(*[F.lit(t) for t in terms])

    def counted(field: str) -> Column:
        counts = lambda kept: F.transform(known, lambda w: F.size(F.filter(kept, lambda t: t == w)))
        of = lambda ts: F.struct(F.size(ts).alias("len"), let(F.filter(ts, lambda t: t.isin(terms)), counts).alias("tf"))
        return let(latin_terms(F.coalesce(F.col(field), F.lit(""))), of).alias(field)

    rows = docs.select("doc_id", *[counted(f) for f in options.boosts])
    held = [F.greatest(F.lit(0), *[F.col(f)["tf"][i] for f in options.boosts]) > 0 for i in range(len(terms))]
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f)["len"].cast("long")).alias(f"len_{f}") for f in options.boosts], *[F.count_if(h).alias(f"df_{i}") for i, h in enumerate(held)]).first()
    rarity = [math.log(1 + (totals["n"] - totals[f"df_{i}"] + 0.5) / (totals[f"df_{i}"] + 0.5)) for i in range(len(terms))]

    def gains(counted: Column, field: str, factors: list[float]) -> Column:
        mean = (totals[f"len_{field}"] or 0) / max(1, totals["n"])
        norm = options.k1 * (1 - options.b + options.b * (counted["len"] / mean if mean else F.lit(0.0)))
        each = F.zip_with(counted["tf"], F.array(*[F.lit(x) for x in factors]), lambda tf, x: F.when(tf > 0, x * tf / (tf + norm)).otherwise(F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    def score(counts: Column, query: dict[str, float]) -> Column:
        weight = [float(query.get(t, 0.0)) * x * (options.k1 + 1) for t, x in zip(terms, rarity)]
        return sum((gains(counts[f], f, [boost * w for w in weight]) for f, boost in options.boosts.items()), F.lit(0.0))

    # one expression from text to scores: a filter on it would be moved below and count every text twice
    return docs.select("doc_id", let(F.struct(*[counted(f) for f in options.boosts]), lambda x: F.array(*[score(x, q) for q in queries])).alias("scores"))


def ranked(found: DataFrame, pool: int, digits: int = 6) -> DataFrame:
    """The top `pool` by score, then id: (doc_id, score, rank from 0)."""
    from pyspark.sql import Window

    top = found.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(pool)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc_id")) - 1)
