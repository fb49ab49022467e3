"""Incremental ingest: a log of changes, and the latest state of each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import web
from ..operators import index as ix


def current(log: DataFrame) -> DataFrame:
    """Live documents of a log (ext_id, seq, deleted, url, title, body, tags)."""
    return ix.latest(log, "ext_id", "seq").filter("NOT deleted").drop("seq", "deleted")


def append_changes(changes: DataFrame, log_path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Append a stream of changes to a Parquet log, one folder a batch, so a batch that is run again replaces itself;
    then call after(batch, number), for one to rebuild an engine."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        if after:
            after(batch, number)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def new_urls(urls: DataFrame, time_column: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of urls without those whose normal form was seen before (within a watermark, if there is a time)."""
    rows = urls.withColumn("normal", web.normalized_url(F.col("url")))
    if time_column:
        return rows.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["normal"])
    return rows.dropDuplicates(["normal"])
