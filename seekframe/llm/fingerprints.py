"""Document fingerprints (6): winnowing of rolling k-gram hashes, with positions kept.

Every run of `GRAM` code points has a polynomial hash modulo 2**64, finished by mixing and cut to 32 bits. Of each
window of `WINDOW` consecutive hashes the least is selected, the rightmost of equal ones, so any passage of
WINDOW + GRAM - 1 code points that two texts share puts a common hash in both fingerprints. A fingerprint is the list of
selected (hash, position), written as 10 hex digits each: the hash and the step from the position before (at most
WINDOW). A text shorter than a gram is one gram; a text with fewer hashes than a window is one window; the empty text
has the empty fingerprint. Likeness is the Jaccard coefficient of the two sets of hashes; two empty ones are alike (1).

The edit of the query takes text from the next document in descending id order. Documents are dealt to ranges of ids
whose bounds come from the id column alone; the first document of a range is also sent to the range above it, so each
text is shuffled once and no task sees more than its range.

A null text is the empty text. A very long text is one row; its hashes are 8 bytes a code point while it is worked on. A
null id sorts before all ids. Repeated rows and other ties of ids are kept, side by side in an order given by their
texts. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, id_back, id_key, prepare, text_of  # noqa: F401

GRAM, WINDOW = 24, 40
#: Id ranges a shuffle partition, on average: so many that partitions come out even.
RANGES = 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of `gram` code points (of the whole text if it is shorter)."""
    n = len(points)
    if not n:
        return np.empty(0, np.uint32)
    gram = min(gram, n)
    with np.errstate(over="ignore"):
        values = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        # doubling: runs of 1, 2, 4, ... points, put together for the binary digits of gram
        out, have, run, size, power = None, 0, values, 1, BASE
        left = gram
        while left:
            if left & 1:
                out = run if out is None else out[: n - have - size + 1] * power + run[have:][: n - have - size + 1]
                have += size
            left >>= 1
            if left:
                run = run[: len(run) - size] * power + run[size:]
                size, power = 2 * size, power * power
        out = out[: n - gram + 1]
        out = out ^ (out >> np.uint64(32))
        out = out * np.uint64(0x94D049BB133111EB)
    return (out >> np.uint64(32)).astype(np.uint32)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the rightmost least hash of every window, ascending."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    window = min(window, n)
    # the least of (hash, n - position) is the rightmost of the least hashes
    keys = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    least, size = keys, 1
    while 2 * size <= window:
        least, size = np.minimum(least[: len(least) - size], least[size:]), 2 * size
    if size < window:
        least = np.minimum(least[: n - window + 1], least[window - size :][: n - window + 1])
    at = n - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def select(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = gram_hashes(points)
    at = winnow(hashes)
    return hashes[at], at


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    rows = np.zeros(len(at), [("h", ">u4"), ("d", "u1")])
    rows["h"], rows["d"] = hashes, np.diff(at, prepend=0)
    return rows.tobytes().hex()


def read(fingerprint: str) -> list[tuple[int, int]]:
    """(hash, position) of a written fingerprint."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), [("h", ">u4"), ("d", "u1")])
    return list(zip(rows["h"].tolist(), np.cumsum(rows["d"].astype(np.int64)).tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "n_chars": batch["t"].str.len(), "fingerprint": [written(*select(code_points(x))) for x in batch["t"]]})

    out = docs.select(id_key().alias("key"), text_of().alias("t")).mapInPandas(run, "key long, n_chars long, fingerprint string")
    return out.select(id_back("key").alias("doc_id"), "n_chars", "fingerprint")


OUT = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by range, ids descending, borrowed rows last -> OUT for the range's own rows."""
    held, names = None, [x.split()[0] for x in OUT.split(", ")]
    for batch in batches:
        out = []
        for part, borrowed, key, text in zip(batch["part"].tolist(), batch["borrowed"].tolist(), batch["key"].tolist(), batch["t"]):
            points = code_points(text)
            here = (part, borrowed, key, points, *select(points))
            if held is not None and held[0] == part and not held[1]:
                own = held[3]
                n = len(own)
                edited = np.concatenate((own[: n - n // 3], points[: n // 3]))
                hashes, at = select(edited)
                digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
                out.append((held[2], n, digest, written(held[4], held[5]), written(hashes, at), likeness(held[4], hashes), likeness(held[4], here[4])))
            held = here
        yield pd.DataFrame(out, columns=names)


def in_ranges(rows: DataFrame, n_ranges: int) -> DataFrame:
    """rows (key, ...) with part and borrowed: each row in its id range; the rows with a range's greatest id also in
    the next range above, those of the last range in the first. Only bounds, one number a range, come to the driver."""
    found = rows.select("key").repartitionByRange(n_ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top")).collect()
    tops = sorted({r["top"] for r in found})
    if not tops:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("borrowed"), *rows.columns)
    # ranges of ids: (tops[i - 1], tops[i]]; a row with key tops[i] is borrowed by range i + 1
    bounds, size = F.expr(f"array({', '.join(f'{x}L' if x > -(2**63) else 'cast(-9223372036854775808 as bigint)' for x in tops)})"), len(tops)
    # the number of bounds under the key, by halving: log2(size) comparisons
    steps = F.expr(f"array({', '.join(str(1 << i) for i in reversed(range(size.bit_length())))})")
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < size) & (F.get(bounds, at + step - 1) < F.col("key")), at + step).otherwise(at))
    place = lambda part, borrowed: F.struct(part.cast("int").alias("part"), F.lit(borrowed).alias("borrowed"))
    places = F.when(F.get(bounds, F.col("own")) == F.col("key"), F.array(place(F.col("own"), 0), place(F.pmod(F.col("own") + 1, F.lit(size)), 1))).otherwise(F.array(place(F.col("own"), 0)))
    return rows.withColumn("own", own).withColumn("place", F.explode(places)).select("place.part", "place.borrowed", *rows.columns)


def op6(docs: DataFrame) -> DataFrame:
    spark = prepare(docs.sparkSession)
    rows = docs.select(id_key().alias("key"), text_of().alias("t"))
    ranges = in_ranges(rows, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = ranges.repartition("part").sortWithinPartitions("part", "borrowed", F.col("key").desc(), "t").mapInPandas(compare_with_next, OUT)
    return out.select(id_back("key").alias("doc_id"), *[x.split()[0] for x in OUT.split(", ")][1:])
