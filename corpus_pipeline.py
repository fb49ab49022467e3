"""The training-data pipeline: `documents` to packed sequences, each stage by one operator of seekframe.llm.

quality classifier -> line dedup -> MinHash near-dedup -> mixing sources to target weights -> packing

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again
before the next; then its own input and intermediate tables are deleted. All but the last return the columns of
`documents`:

- quality: documents scored under 0.5 go, row by row: another text under the same id stays.
- lines: lines of at least 10 characters that an earlier document has go; documents of which no word is left go too.
  Texts and n_chars are those after the removal.
- near_duplicates: five-word shingles, similarity 0.8; of each component the document with the least id stays.
- mix: the golden-ratio schedule. A document is repeated for every pass of the schedule over its source that reads it;
  a pass that reads a part of it only (at a block's end) keeps that part, from word to word. Rows that repeat an id
  are sized, cut and repeated each on their own. Sources over their target
  lose documents, sources under it repeat theirs, at most three times. Rows are dealt by the slot that first reads
  them and written in its order, so the packed sequences follow the schedule.
- pack: byte-level ids, windows of 2,048 tokens.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns are as each operator's module states; columns
beyond those of `documents` are dropped. Rows without an id are deduplicated as one document; rows that repeat an id
stay or go together in near_duplicates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from seekframe.llm._common import WORD, WRITTEN, documents, id_key, prepare, release, remove, shared_dir, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS = 5
#: SQL has no tokenizer and no random trees; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classified(docs, labels).filter("NOT kept").select(id_key("id").alias("rejected"), "digest").distinct()
    return docs.select(*COLUMNS).join(judged, (id_key() == F.col("rejected")) & (quality_classifier.row_digest() == F.col("digest")), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    out = out.filter((F.col("n_dropped") == 0) | F.col("kept_text").rlike(WORD))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, SHINGLE_WORDS)
    copies = found.filter("key <> component").select(F.col("key").alias("copy")).distinct()
    return docs.join(copies, id_key() == F.col("copy"), "left_anti").select(*COLUMNS)


def every_column() -> list:
    """The values of COLUMNS, and which are null: hashes pass over nulls."""
    return [F.col(c) for c in COLUMNS] + [F.col(c).isNull() for c in COLUMNS]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # equal rows have one digest; they are interchangeable, so the passes of all of them are given to one
    rows = docs.select(*COLUMNS, id_key().alias("key"), F.xxhash64(*every_column(), F.lit(1)).alias("d1"), F.xxhash64(F.lit(2), *every_column()).alias("d2"))
    placed, pieces = mixing.mix_sources(rows, keep=("key", "d1", "d2"))
    passes = pieces.groupBy("row", "epoch").agg(F.min("begin").alias("begin"), F.sum("taken").alias("taken"), F.min("slot").alias("slot"))
    passes = passes.join(placed.select("row", "key", "d1", "d2", "size"), "row").select("key", "d1", "d2", F.struct("begin", "taken", "size", "slot").alias("p"))
    rows = rows.dropDuplicates(["key", "d1", "d2"]).join(passes, ["key", "d1", "d2"])
    whole = F.col("p.taken") == F.col("p.size")
    words = F.regexp_extract_all(text_of(), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words, F.col("p.begin").cast("int") + 1, F.col("p.taken").cast("int")), "")
    text = F.when(whole, F.col("text")).otherwise(cut)
    rows = rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    # every file holds slots from all over the schedule in their order, and so its own mix near the targets
    slot = F.col("p.slot")
    return rows.withColumn("slot", slot).repartition("slot").sortWithinPartitions("slot", "doc_id").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op4(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mix_sources", mix), ("pack_windows", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path, last = f"{shared_dir(prepare(spark))}/seekframe/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        since = len(WRITTEN)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{path}/{i}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{path}/{i}-{name}")
            # what the stage has read and written on its way is no longer needed
            release(spark, since)
            if last:
                remove(spark, last)
            last = f"{path}/{i}-{name}"
    return docs
