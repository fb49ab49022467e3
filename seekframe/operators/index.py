"""The inverted index as tables, its maintenance and its boolean and phrase retrieval.

Tables: docs (doc_id, title, body, tags), postings (field, term, doc_id, tf, positions), lengths (field, doc_id, len),
field_stats (field, total_tokens, n_docs, avg_len). All are plain DataFrames; Catalyst prunes what a query leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import Lexicon, places_by_term, term_arrays

FIELDS = ("title", "body", "tags")


def fielded(documents: DataFrame) -> DataFrame:
    """doc_id, title (first line), body (the rest), tags (language and source) of the documents table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.instr(text, "\n")
    return documents.select("doc_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit("")).alias("body"), F.concat_ws(",", "lang", "source").alias("tags"))


def by_field(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """doc_id, field, text: one row a document and field."""
    pairs = ", ".join(f"'{f}', coalesce({f}, '')" for f in fields)
    return docs.selectExpr("doc_id", f"stack({len(fields)}, {pairs}) AS (field, text)")


def postings(rows: DataFrame, lexicon: Lexicon | None = None, terms: list[str] | None = None, stopwords: bool = False) -> DataFrame:
    """(field, term, doc_id, tf, positions) of rows (doc_id, field, text); with terms, only theirs.

    A field's tokens are all in one row, so its postings are made there: nothing is shuffled.
    """
    if terms is not None:  # few rows are left after the filter; those are grouped
        held = F.transform("terms", lambda t, i: F.when(t.isin(terms), F.struct(t.alias("term"), i.alias("position"))))
        found = term_arrays(rows, "text", ["doc_id", "field"], lexicon, stopwords).select("doc_id", "field", F.inline(F.filter(held, lambda x: x.isNotNull())))
        return found.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    found = term_arrays(rows, "text", ["doc_id", "field"], lexicon, stopwords)
    found = found.select("field", "doc_id", F.inline(places_by_term(F.col("terms"))))
    return found.select("field", "term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")


def lengths(rows: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(field, doc_id, len): tokens of each field; empty fields have length 0."""
    return term_arrays(rows, "text", ["doc_id", "field"], lexicon).select("field", "doc_id", F.greatest(F.size("terms"), F.lit(0)).cast("long").alias("len"))


def field_stats(lens: DataFrame) -> DataFrame:
    """(field, total_tokens, n_docs, avg_len); documents whose field is empty count too."""
    return lens.groupBy("field").agg(F.sum("len").alias("total_tokens"), F.count(F.lit(1)).alias("n_docs"), (F.sum("len") / F.count(F.lit(1))).alias("avg_len"))


def doc_freq(posts: DataFrame) -> DataFrame:
    """(term, df): distinct documents over all fields."""
    return posts.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


def max_field_freq(posts: DataFrame) -> DataFrame:
    """(term, max_df, sum_df): per term the largest and the summed number of documents of one field."""
    return posts.groupBy("term", "field").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.max("n").alias("max_df"), F.sum("n").alias("sum_df"))


def latest(log: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """Upsert: of the rows of a key the last."""
    keys = [key] if isinstance(key, str) else key
    names = log.columns
    ordered = F.col(order) if isinstance(order, str) else order
    return log.groupBy(*keys).agg(F.max_by(F.struct(*names), ordered).alias("r")).select("r.*")


def without(docs: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(deleted.select(key).distinct(), key, "left_anti")


def compacted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with dense ids `new_id` from 0 in the order of key.

    Ranges of keys are fixed first, by one bound each; a row's id is its rank in its range plus the sizes of the ranges
    below. Bounds and sizes, two numbers a shuffle partition, are all that comes to the driver.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("top")).collect()
    tops = sorted({r["top"] for r in found if r["top"] is not None})
    part = F.lit(0)
    if tops:
        bounds, steps = F.array(*[F.lit(x) for x in tops]), F.array(*[F.lit(1 << i) for i in reversed(range(len(tops).bit_length()))])
        part = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < len(tops)) & (F.get(bounds, at + step - 1) < F.col(key)), at + step).otherwise(at))
    rows = docs.withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    below, total = [], 0
    for i in range(max(1, len(tops))):
        below.append(total)
        total += sizes.get(i, 0)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn("new_id", F.get(F.array(*[F.lit(x).cast("long") for x in below]), F.col("_part")) + rank).drop("_part")


def conjunctive(posts: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id): documents that have every term in some field."""
    terms = list(dict.fromkeys(terms))
    return posts.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(terms)).select("doc_id")


def phrase(posts: DataFrame, terms: list[str]) -> DataFrame:
    """(field, doc_id, start): every place where the terms stand one after the other in a field."""
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)])
    found = posts.filter(F.col("term").isin(terms)).select("field", "doc_id", "term", F.explode("positions").alias("p")).withColumn("x", F.explode(places)).filter("x.t = term")
    return found.groupBy("field", "doc_id", (F.col("p") - F.col("x.i")).alias("start")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms)).select("field", "doc_id", "start")
