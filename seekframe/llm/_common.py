"""What the training-data operators share: shared storage, clean inputs, size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A lookup side is broadcast up to so many rows (of a few dozen bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000

#: Rows of a batch that a Python worker holds at once, at most.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

#: Stands for a null document id inside an operator; it sorts before every other id.
NULL_ID = -(2**63)

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and keep their batches of texts small."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where one machine is all, a new
    temporary folder takes its place if it is unset; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seekframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables written under the shared folder by this process and not yet released.
WRITTEN: list[str] = []


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    It is deleted by `release`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seekframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    files, found = _files(spark, path)
    files.deleteOnExit(found)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that `saved` has written since WRITTEN had that length; results that read them must be written by then."""
    for path in WRITTEN[since:]:
        remove(spark, path)
    del WRITTEN[since:]


def remove(spark: SparkSession, path: str) -> None:
    files, found = _files(spark, path)
    files.delete(found, True)


def lookup(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written lookup table for broadcast if it has at most `most` rows; else leave the join to Catalyst and AQE."""
    return F.broadcast(small) if small.count() <= most else small


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once: inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_key(col: str | Column = "doc_id") -> Column:
    """The id with null replaced by NULL_ID, which sorts first."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID)).cast("long")


def id_back(col: str) -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def empty_like(df: DataFrame) -> bool:
    return df.isEmpty()
