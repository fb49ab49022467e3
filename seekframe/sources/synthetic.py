"""A corpus of any size made of the sentences of a small one, to measure with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import compacted

#: Sentences of at most so many characters are left out.
SHORTEST = 8


def sentences(docs: DataFrame) -> DataFrame:
    """(sentence): the distinct longer sentences of bodies, cut after each full stop of Han text."""
    cut = docs.select(F.explode(F.split(F.coalesce("body", F.lit("")), "(?<=[。！？])")).alias("sentence")).select(F.trim("sentence").alias("sentence"))
    return cut.filter(F.length("sentence") > SHORTEST).distinct()


def synthesize(docs: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n documents (ext_id, url, title, body, tags) of two to four paragraphs of two to four sentences of docs each; the title
    and tags are those of one of docs. Equal arguments give equal rows; docs without a sentence give none.

    Each place draws a number by hash and meets its sentence in a join, so neither side is held by the driver.
    """
    pool, like = compacted(sentences(docs), "sentence"), compacted(docs.select("ext_id", "title", "tags"), "ext_id")
    n_sentences, n_docs = pool.count(), like.count()
    draw = lambda below, *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(below))
    if not n_sentences:
        return docs.sparkSession.createDataFrame([], "ext_id string, url string, title string, body string, tags string")

    def up_to(*of: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), (draw(3, *of) + 1).cast("int")))

    rows = docs.sparkSession.range(n).select("id", draw(n_docs, "id", F.lit("title")).alias("like"))
    places = rows.select("id", up_to(F.col("id"), F.lit("paragraphs")).alias("p")).select("id", "p", up_to(F.col("id"), F.col("p")).alias("s"))
    drawn = places.withColumn("new_id", draw(n_sentences, "id", "p", "s")).join(pool, "new_id")
    texts = drawn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "s", "sentence"))).alias("x"))  # 16 at most
    broken = lambda x: F.when((x["p"] > 0) & (x["s"] == 0), F.lit("\n\n")).otherwise("")
    body = F.aggregate("x", F.lit(""), lambda held, x: F.concat(held, broken(x), x["sentence"]))
    named = rows.join(like.withColumnRenamed("new_id", "like").drop("ext_id"), "like")
    title = F.concat("title", F.lit("（变体 "), F.col("id").cast("string"), F.lit("）"))
    return texts.join(named, "id").select(F.concat(F.lit("bench-"), F.col("id").cast("string")).alias("ext_id"), F.lit("").alias("url"), title.alias("title"), body.alias("body"), "tags")
