"""Token-ID output (2): per-document zstandard frames under one trained dictionary, with an offset index.

Format (three tables in one folder, written by Spark's writer, so any store that Spark writes will do):

- `dictionary`: one row (dict_hash, dictionary): the zstandard dictionary and the sha256 of its bytes.
- `frames`: blocks of at most `BLOCK_BYTES` (or one longer document), in ascending document order. A block has shard,
  block, dict_hash, first_id, last_id, n_tokens; index: for each document (id int64, n_tokens int64, end int64), where
  end is the offset in `data` after its frame; data: the frames. One frame is one document: its ids as little-endian
  unsigned integers of `width` bytes (2, which both public vocabularies fit, or 4), compressed alone. A short document is read by its block's id range (kept in Parquet
  statistics), its index entry and one frame.

The dictionary is trained on serialized ids of `SAMPLE_DOCS` documents (those with the smallest id hash; of each at most
`SAMPLE_IDS` ids, in pieces from its beginning to its end): it only affects size, never content. Texts are encoded where they are read; only compressed frames
are shuffled, once, by document id.

A null text is the empty text (just the end id). A very long text is one frame, in a block of its own. A null id sorts
first. Repeated rows, and other ties of ids, are kept side by side in the order of their frames. An empty table gives
empty files. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import NULL_ID, id_back, id_key, lookup, prepare, saved, shared_dir, text_of

SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 512, 16_384, 65_536, 1 << 20, 3
BLOCK_SCHEMA = "shard int, block int, dict_hash string, first_id long, last_id long, n_tokens long, index binary, data binary"


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def with_end(kind: str, path: str, end_id: int):
    encode = tokens.encoder(kind, path).encode
    return lambda text: np.append(encode(text), np.uint16(end_id))


def zstd_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def spread(ids: np.ndarray, most: int = SAMPLE_IDS, pieces: int = 16) -> np.ndarray:
    """At most so many of the ids, in pieces that lie evenly over them."""
    if len(ids) <= most:
        return ids
    size = most // pieces
    return np.concatenate([ids[a : a + size] for a in np.linspace(0, len(ids) - size, pieces).astype(int)])


def train_dictionary(docs: DataFrame, kind: str, path: str, end_id: int, width: int) -> bytes:
    import zstandard

    ids = [r[0] for r in docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not ids:
        return b""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = with_end(kind, path, end_id)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "data": [serialized(spread(encode(t)), width) for t in batch["t"]]})

    texts = docs.filter(F.col("doc_id").isin(ids)).select(F.col("doc_id").cast("long").alias("key"), text_of().alias("t"))
    samples = [bytes(r["data"]) for r in texts.mapInPandas(pieces, "key long, data binary").orderBy("key", "data").limit(SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_token_files(docs: DataFrame, path: str, kind: str, vocabulary: str, end_id: int, width: int = 2) -> None:
    """Encode every document, append end_id and write the three tables under path (a folder that Spark can write)."""
    spark = prepare(docs.sparkSession)
    dictionary = train_dictionary(docs, kind, vocabulary, end_id, width)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        zstd, encode = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstd_dictionary(dictionary)), with_end(kind, vocabulary, end_id)
        for batch in batches:
            n, frames = [], []
            for text in batch["t"]:
                ids = encode(text)
                n.append(len(ids))
                frames.append(zstd.compress(serialized(ids, width)))
            yield pd.DataFrame({"key": batch["key"], "n": n, "frame": frames})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            index = np.array([(k, n, e) for k, n, e in zip([x[0] for x in held], [x[1] for x in held], np.cumsum([len(x[2]) for x in held]))], "<i8")
            return (shard, block, dict_hash, held[0][0], held[-1][0], int(sum(x[1] for x in held)), index.tobytes(), b"".join(x[2] for x in held))

        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            for x in zip(batch["key"].tolist(), batch["n"].tolist(), batch["frame"]):
                if held and size + len(x[2]) > BLOCK_BYTES:
                    yield pd.DataFrame([row()], columns=names)
                    block, held, size = block + 1, [], 0
                held.append(x)
                size += len(x[2])
        if held:
            yield pd.DataFrame([row()], columns=names)

    encoded = saved(docs.select(id_key().alias("key"), text_of().alias("t")).mapInPandas(compress, "key long, n long, frame binary"), "encoded")
    encoded.repartitionByRange("key").sortWithinPartitions("key", "frame").mapInPandas(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/frames")


def read_token_files(spark: SparkSession, path: str, width: int = 2, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files; with ids=True also ids array<int>."""
    dictionaries = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}  # one row
    schema = "shard int, block int, key long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        readers: dict = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.dict_hash not in readers:
                    data = dictionaries[row.dict_hash]
                    if hashlib.sha256(data).hexdigest() != row.dict_hash:
                        raise ValueError(f"the dictionary of shard {row.shard} is damaged")
                    readers[row.dict_hash] = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(data))
                index, view, a, out = np.frombuffer(row.index, "<i8").reshape(-1, 3), memoryview(row.data), 0, []
                starts = np.cumsum(index[:, 1]) - index[:, 1]
                for (key, n, b), start in zip(index.tolist(), starts.tolist()):
                    found = np.frombuffer(readers[row.dict_hash].decompress(view[a:b]), f"<u{width}")
                    if len(found) != n:
                        raise ValueError(f"document {key}: {len(found)} ids in its frame, {n} in its index")
                    out.append((row.shard, row.block, key, start, n, zlib.crc32(serialized(found, 4))) + ((found.astype(np.int32),) if ids else ()))
                    a = b
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    frames = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/frames")
    heads = frames.select("shard", "block", "n_tokens")
    shards = heads.groupBy("shard").agg(F.sum("n_tokens").alias("held"))  # one row a shard
    shards = shards.select("shard", (F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("held")).alias("above"))
    bases = heads.join(shards, "shard").select("shard", "block", (F.col("above") + F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("base"))
    rows = frames.mapInPandas(decode, schema)
    out = rows.join(lookup(saved(bases, "bases")), ["shard", "block"])
    return out.select(id_back("key").alias("doc_id"), (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def read_document(spark: SparkSession, path: str, doc_id: int, width: int = 2) -> list[np.ndarray]:
    """The ids of one document (of each row that had this id), from its block alone."""
    key = NULL_ID if doc_id is None else doc_id
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/frames").filter((F.col("first_id") <= key) & (F.col("last_id") >= key)).collect()
    import zstandard

    found = []
    for row in blocks:
        data = bytes(spark.read.parquet(f"{path}/dictionary").filter(F.col("dict_hash") == row["dict_hash"]).first()["dictionary"])
        zstd, index = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(data)), np.frombuffer(row["index"], "<i8").reshape(-1, 3)
        for i in np.flatnonzero(index[:, 0] == key).tolist():
            frame = bytes(row["data"])[index[i - 1, 2] if i else 0 : index[i, 2]]
            found.append(np.frombuffer(zstd.decompress(frame), f"<u{width}"))
    return found


def op2(docs: DataFrame) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/seekframe/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, "word", tokens.vocabulary("word_bpe_49k.json"), 2)
    return read_token_files(docs.sparkSession, path)
