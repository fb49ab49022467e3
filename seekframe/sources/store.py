"""A saved engine: one Parquet folder a table, and a manifest written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2


class StaleStore(ValueError):
    """The store's version, options or checksum are not those asked for: rebuild."""


def checksum(df: DataFrame) -> list:
    """[rows, sum] of a table in any order: the sum of its rows' 64-bit hashes, combined before the shuffle."""
    total = F.coalesce(F.sum(F.xxhash64(*[f"`{c}`" for c in sorted(df.columns)]).cast("decimal(20,0)")), F.lit(0))
    found = df.agg(F.count(F.lit(1)).alias("rows"), total.cast("string").alias("sum")).first()
    return [found["rows"], found["sum"]]


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], facts: dict) -> None:
    """Tables go to a folder of their own; the manifest that names it is replaced last, so a reader sees the old or the
    new engine whole. The manifest keeps a checksum of each table as it was read back."""
    version, sums = uuid.uuid4().hex, {}
    for name, df in tables.items():
        writer = df.write
        if name == "postings":
            writer = writer.partitionBy("field")
        writer.parquet(f"{path}/{version}/{name}")
        sums[name] = checksum(spark.read.parquet(f"{path}/{version}/{name}"))
    manifest = json.dumps({**facts, "format": VERSION, "folder": version, "tables": sorted(tables), "checksums": sums})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, expected: dict | None = None, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """Tables and facts. With verify, each table is read once and must have its checksum; without, only the manifest is
    checked, for stores whose files are checked elsewhere."""
    facts = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if facts.get("format") != VERSION:
        raise StaleStore(f"format {facts.get('format')} is not {VERSION}")
    for key, value in (expected or {}).items():
        if facts.get(key) != value:
            raise StaleStore(f"{key} is {facts.get(key)!r}, not {value!r}")
    tables = {t: spark.read.parquet(f"{path}/{facts['folder']}/{t}") for t in facts["tables"]}
    for name, df in tables.items() if verify else ():
        try:
            found = checksum(df)
        except Exception as e:
            raise StaleStore(f"table {name} can't be read") from e
        if found != facts["checksums"][name]:
            raise StaleStore(f"table {name} has rows and checksum {found}, not {facts['checksums'][name]}")
    return tables, facts
