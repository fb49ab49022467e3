"""Reading and writing documents, queries and dictionaries as text."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id STRING, title STRING, body STRING, url STRING, tags STRING"


def json_lines(lines: DataFrame, source: str | None = "doc") -> DataFrame:
    """(ext_id, url, title, body, tags) of lines (value, line from 1). Blank, `#` and malformed lines go, and rows without
    title and body; tags may be a list or a scalar; an id is source-line, or line without a source, where none is given."""
    rows = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).withColumn("j", F.try_parse_json("value")).filter("j IS NOT NULL")
    rows = rows.filter("startswith(schema_of_variant(j), 'OBJECT')")
    text = lambda path: F.expr(f"coalesce(try_variant_get(j, '$.{path}', 'string'), '')")
    tags = F.coalesce(F.array_join(F.expr("try_variant_get(j, '$.tags', 'array<string>')"), ","), text("tags"))
    out = rows.select(F.expr("try_variant_get(j, '$.id', 'string')").alias("id"), "line", text("url").alias("url"), text("title").alias("title"), text("body").alias("body"), tags.alias("tags"))
    out = out.filter((F.trim("title") != "") | (F.trim("body") != ""))
    place = F.col("line").cast("string")
    return out.select(F.coalesce("id", place if source is None else F.concat(F.lit(f"{source}-"), place)).alias("ext_id"), "url", "title", "body", "tags")


def numbered_lines(spark: SparkSession, paths, names: str | None = None) -> DataFrame:
    """(file, value, line from 1) of text files, or of a folder's files with such names; a file's lines are numbered where
    it is read."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter=names).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\R")).alias("i", "value")).select("file", "value", (F.col("i") + 1).alias("line"))


def _named_lines(lines: DataFrame) -> DataFrame:
    """Documents of the lines of several files; one without an id is called by its file and line."""
    name = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    return json_lines(lines.select("value", F.concat_ws("-", name, F.col("line").cast("string")).alias("line")), None)


def read_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """All *.jsonl files of a folder, not of its subfolders."""
    return _named_lines(numbered_lines(spark, directory, "*.jsonl"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """The files that manifest.txt lists; comments and blank lines go. Without a manifest or a listed file there is a
    warning, and what is there is read."""
    listed, nothing = f"{directory}/manifest.txt", "ext_id string, url string, title string, body string, tags string"
    if not exists(spark, listed):
        warnings.warn(f"there is no {listed}", stacklevel=2)
        return spark.createDataFrame([], nothing)
    names = [r["value"].strip() for r in spark.read.text(listed).collect()]
    paths = [f"{directory}/{x}" for x in names if x and not x.startswith("#")]
    found = [p for p in paths if exists(spark, p)]
    for path in sorted(set(paths) - set(found)):
        warnings.warn(f"{listed} names {path}, which is missing", stacklevel=2)
    return _named_lines(numbered_lines(spark, found)) if found else spark.createDataFrame([], nothing)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant, kind, note) of evaluation queries; a malformed line is an error."""
    lines = numbered_lines(spark, path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    q = F.from_json("value", "id STRING, query STRING, relevant ARRAY<STRING>, kind STRING, note STRING", {"mode": "FAILFAST"})
    return lines.select("line", q.alias("q")).select(F.coalesce("q.id", F.concat(F.lit("q"), F.col("line").cast("string"))).alias("query_id"), "q.query", F.coalesce("q.relevant", F.array().cast("array<string>")).alias("relevant"), F.coalesce("q.kind", F.lit("lexical")).alias("kind"), F.coalesce("q.note", F.lit("")).alias("note"))


def to_json_lines(docs: DataFrame) -> DataFrame:
    """(value): documents (ext_id, url, title, body, tags) as JSON lines."""
    from ..functions.text import split_tags

    return docs.select(F.to_json(F.struct(F.col("ext_id").alias("id"), "url", "title", "body", split_tags(F.col("tags")).alias("tags"))).alias("value"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row (n_docs, sum_1 ... sum_4, checksum): an order-free checksum of id, title and body: the sums of the four 32-bit
    parts of each document's md5, combined before the shuffle."""
    h = F.md5(F.encode(F.concat_ws("\x00", "ext_id", "title", "body"), "UTF-8"))
    parts = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"p{i + 1}") for i in range(4)]
    sums = docs.select(*parts).agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias(f"sum_{i}") for i in range(1, 5)])
    return sums.withColumn("checksum", F.xxhash64(*[f"sum_{i}" for i in range(1, 5)]))
