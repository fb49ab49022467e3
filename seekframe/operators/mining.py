"""New-word mining over Han runs: n-gram counts, inner cohesion and freedom of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import HAN

MAX_LENGTH, MIN_LENGTH, MIN_FREQ, MIN_COHESION, MIN_FREEDOM, MAX_WORDS = 6, 2, 2, 0.5, 0.8, 80_000


def gram_places(texts: DataFrame, column: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """(gram, before, after): every Han n-gram of each run with its neighbours in the run (null at its ends)."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(f"[{HAN}]+"), F.lit(0))).alias("run"))
    places = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    places = places.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_length), F.length("run") - F.col("at") + 1))).alias("n"))
    near = lambda at: F.when((at >= 1) & (at <= F.length("run")), F.substring(F.col("run"), at, F.lit(1)))
    return places.select(F.substring(F.col("run"), F.col("at"), F.col("n")).alias("gram"), near(F.col("at") - 1).alias("before"), near(F.col("at") + F.col("n")).alias("after"))


def gram_counts(places: DataFrame) -> DataFrame:
    return places.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))


def cohesion(counts: DataFrame, min_freq: int = MIN_FREQ, min_length: int = MIN_LENGTH) -> DataFrame:
    """(gram, freq, cohesion): the least normalised pointwise information over all ways to halve a gram."""
    total = counts.agg(F.sum("freq").alias("total"))
    grams = counts.filter((F.length("gram") >= min_length) & (F.col("freq") >= min_freq)).join(F.broadcast(total))  # total: one row
    halves = grams.select("gram", "freq", "total", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("i"))
    halves = halves.select("gram", "freq", "total", F.substring(F.col("gram"), F.lit(1), F.col("i")).alias("l"), F.substring(F.col("gram"), F.col("i") + 1, F.length("gram")).alias("r"))
    left, right = counts.select(F.col("gram").alias("l"), F.col("freq").alias("fl")), counts.select(F.col("gram").alias("r"), F.col("freq").alias("fr"))
    both = halves.join(left, "l", "left").join(right, "r", "left")
    half = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.5)), F.lit(0.5))
    told = F.log2(F.col("freq").cast("double") * F.col("total") / (half("fl") * half("fr"))) / -F.log2(F.col("freq").cast("double") / F.col("total"))
    return both.groupBy("gram", "freq").agg(F.min(told).alias("cohesion"))


def freedom(places: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, freedom): the lesser entropy of the characters before and after; 0 without neighbours."""
    sides = places.join(grams.select("gram"), "gram", "left_semi").select("gram", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("before").alias("c")), F.struct(F.lit("r").alias("side"), F.col("after").alias("c")))).alias("x")).select("gram", "x.*").filter("c IS NOT NULL")
    counts = sides.groupBy("gram", "side", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # entropy from sums: log2(sum n) - sum(n log2 n) / sum n
    entropy = counts.groupBy("gram", "side").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    found = entropy.groupBy("gram").agg(F.coalesce(F.max(F.when(F.col("side") == "l", F.col("h"))), F.lit(0.0)).alias("l"), F.coalesce(F.max(F.when(F.col("side") == "r", F.col("h"))), F.lit(0.0)).alias("r"))
    return grams.select("gram").join(found, "gram", "left").select("gram", F.coalesce(F.least("l", "r"), F.lit(0.0)).alias("freedom"))


def mine_words(texts: DataFrame, column: str = "text", max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH, min_freq: int = MIN_FREQ, min_cohesion: float = MIN_COHESION, min_freedom: float = MIN_FREEDOM, max_words: int = MAX_WORDS) -> DataFrame:
    """(term, freq, cohesion, freedom): mined words, by frequency, cohesion and term; max_words is the lexicon's size."""
    places = gram_places(texts, column, max_length)
    tight = cohesion(gram_counts(places), min_freq, min_length).filter(F.col("cohesion") >= min_cohesion)
    words = tight.join(freedom(places, tight), "gram").filter(F.col("freedom") >= min_freedom)
    return words.select(F.col("gram").alias("term"), "freq", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom")).orderBy(F.desc("freq"), F.desc("cohesion"), "term").limit(max_words)
