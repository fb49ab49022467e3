"""Line dedup (10): documents probe a sharded minimal perfect hash instead of joining lines.

1. Each line is reduced to a key (stripped, A-Z lower-cased) and to its hash (64 bits) and fingerprint (32 bits).
2. A grouped aggregation, combined before the shuffle, gives for each distinct line its first document and its count.
3. All distinct line hashes are dealt to shards of about `SHARD_KEYS`. A shard is one minimal perfect hash: a pilot per
   bucket places every key in a slot of its own, and compact arrays hold by slot the fingerprint (32 bits), the count (32
   bits, saturated) and the first document (64 bits). Shards are one row each, about 17 bytes a line. Lines of equal hash
   and different fingerprint are kept beside the arrays.
4. The documents' hashes go to their shard. A shard has one copy, or as many as give each at most about `PROBES` hashes
   by its lines' counts, and documents are dealt over them, so that a frequent line does not load one task. A task reads
   the shard's arrays first and then probes them, one array read a line, no join: a line goes if its count is over one
   and its first document is another.

The count of a line is 1 if it is in one document, else the number of rows that hold it.

A null text is one empty line; a null id sorts before all others and is a document of its own. Rows that repeat a doc_id
count as one document; each row loses its own lines, and no list is longer than a text's lines. A very long text is one
row; its lines are dealt like any others. Ties do not occur: the first document is the least id. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, ascii_lower, id_back, id_key, lookup, prepare, saved, text_of

BLANK = " \t\n\x0b\f\r"
#: Keys of a shard, which one task holds; least copies of a shard, among which the documents are dealt; hashes for a copy.
SHARD_KEYS, SALTS, PROBES = 100_000, 1, 250_000
#: Mean keys of a pilot's bucket.
BUCKET = 4


def line_hash(line):
    return F.xxhash64(F.lit(1), line)


def line_fingerprint(line):
    return F.hash(F.lit(2), line)


def mix64(x: np.ndarray, salt) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x ^ (np.asarray(salt, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct uint64 keys: (pilot of each bucket, slot of each key).

    Buckets are placed from the largest to the smallest; all buckets of one size try the same pilot at once, and those
    whose slots are free and differ take them.
    """
    n = len(keys)
    n_buckets = max(1, -(-n // BUCKET))
    bucket = (mix64(keys, 1) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    pilots, slots, taken = np.zeros(n_buckets, np.uint32), np.full(n, -1, np.int64), np.zeros(n, bool)
    for size in range(int(sizes.max(initial=0)), 0, -1):
        todo, pilot = np.flatnonzero(sizes == size), 0
        members = order[starts[todo][:, None] + np.arange(size)]
        while len(todo):
            if len(todo) <= 64 or pilot > 4096:  # few are left: each searches alone, many pilots at a time
                for b, own in zip(todo, members):
                    p = pilot
                    while True:
                        trial = np.arange(p, p + 4096, dtype=np.uint64)
                        at = (mix64(keys[own][None, :], trial[:, None] + np.uint64(2)) % np.uint64(n)).astype(np.int64)
                        good = ~taken[at].any(1)
                        if size > 1:
                            s = np.sort(at, 1)
                            good &= (s[:, 1:] != s[:, :-1]).all(1)
                        if good.any():
                            k = int(good.argmax())
                            pilots[b], slots[own], taken[at[k]] = p + k, at[k], True
                            break
                        p += 4096
                break
            at = (mix64(keys[members], pilot + 2) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(1)
            if size > 1:
                s = np.sort(at, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            # of the buckets that want a slot at once, the first has it
            wanted, rows = at[good].ravel(), np.repeat(np.flatnonzero(good), size)
            first = np.full(n, len(todo), np.int64)
            np.minimum.at(first, wanted, rows)
            won = np.flatnonzero(good)[(first[at[good]] == np.flatnonzero(good)[:, None]).all(1)]
            pilots[todo[won]], taken[at[won].ravel()] = pilot, True
            slots[members[won].ravel()] = at[won].ravel()
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, members, pilot = todo[rest], members[rest], pilot + 1
    return pilots, slots


ARRAYS = {"fingerprints": ("fp", np.int32), "counts": ("n_docs", np.uint32), "firsts": ("first_doc", np.int64)}


def shard_rows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's rows (h, fp, first_doc, n_docs) as one row of arrays."""
    rows = rows.sort_values(["h", "fp"], kind="stable")
    keys = rows["h"].to_numpy(np.int64).view(np.uint64)
    same = np.flatnonzero(keys[1:] == keys[:-1]) + 1  # equal hashes of different lines: kept beside the arrays
    main = np.ones(len(keys), bool)
    main[same] = False
    pilots, slots = build_mph(keys[main])
    out = {"shard": [key[0]], "pilots": [pilots.tobytes()]}
    for name, (column, kind) in ARRAYS.items():
        values = np.empty(int(main.sum()), kind)
        values[slots] = np.minimum(rows[column].to_numpy(np.int64)[main], np.iinfo(kind).max)
        out[name] = [values.tobytes()]
    out["rest"] = [rows.iloc[same][["h", "fp", "first_doc", "n_docs"]].to_numpy(np.int64).tobytes()]
    return pd.DataFrame(out)


HELD = ("pilots", *ARRAYS, "rest")
SHARD_SCHEMA = "shard int, " + ", ".join(f"{x} binary" for x in HELD)


def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by shard and salt, the shard's arrays first, then its probes -> (key, text, h) of the lines to drop."""
    arrays = None
    for batch in batches:
        held = batch["pilots"].notna().to_numpy()
        doc, texts, hs, fps = (batch[c].to_numpy(np.int64) for c in ("key", "text", "h", "fp"))
        gone = np.zeros(len(batch), bool)
        cuts = [*np.flatnonzero(held).tolist(), len(batch)]
        spans = [(0, cuts[0], None), *((a + 1, b, batch.iloc[a]) for a, b in zip(cuts, cuts[1:]))]
        for a, b, row in spans:
            if row is not None:
                rest = np.frombuffer(row["rest"], np.int64).reshape(-1, 4).tolist()
                arrays = [np.frombuffer(row["pilots"], np.uint32), *[np.frombuffer(row[x], kind) for x, (_, kind) in ARRAYS.items()], {(h, fp): (first, n) for h, fp, first, n in rest}]
            if a >= b or arrays is None:
                continue
            pilots, fingerprints, counts, firsts, rest = arrays
            key = hs[a:b].view(np.uint64)
            bucket = (mix64(key, 1) % np.uint64(len(pilots))).astype(np.int64)
            slot = (mix64(key, pilots[bucket].astype(np.uint64) + np.uint64(2)) % np.uint64(len(counts))).astype(np.int64)
            gone[a:b] = (counts[slot] > 1) & (firsts[slot] != doc[a:b]) & (fingerprints[slot] == fps[a:b])
            if rest:
                for i in np.flatnonzero(fingerprints[slot] != fps[a:b]).tolist():
                    first, n = rest.get((int(hs[a + i]), int(fps[a + i])), (0, 0))
                    gone[a + i] = n > 1 and first != doc[a + i]
        yield pd.DataFrame({"key": doc[gone], "text": texts[gone], "h": hs[gone]})


def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, hashes, drops in zip(batch["line_text"], batch["line_hashes"], batch["line_drops"]):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if drops is not None and len(drops):
                gone = set(np.asarray(drops).tolist())
                lines = [x for x, h in zip(lines, np.asarray(hashes).tolist()) if h not in gone]
                text = "\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(text)
        yield batch.drop(columns=["line_text", "line_hashes", "line_drops"]).assign(n_lines=n_lines, n_dropped=n_dropped, kept_text=kept)


def counted_lines(lines: DataFrame) -> DataFrame:
    """(h, fp, first_doc, n_docs) of every distinct line."""
    found = lines.groupBy("h", "fp").agg(F.min("key").alias("first_doc"), F.max("key").alias("last_doc"), F.count(F.lit(1)).alias("n"))
    return found.select("h", "fp", "first_doc", F.when(F.col("first_doc") == F.col("last_doc"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n_docs"))


def copies_of(keyed: DataFrame, n_lines: int, n_shards: int) -> tuple[int, DataFrame | None]:
    """Copies of a usual shard; (shard, salts) of those that need more, if any. keyed: (shard, n_docs) of each key.

    A table of at most n_lines / (SALTS * PROBES) rows.
    """
    usual = max(SALTS, -(-n_lines // (n_shards * PROBES)))
    more = keyed.groupBy("shard").agg(F.sum("n_docs").alias("load")).filter(F.col("load") > usual * PROBES)
    more = saved(more.select("shard", (F.lit(usual) + F.ceil(F.col("load") / PROBES)).cast("int").alias("salts")), "hot_shards")
    return usual, None if more.isEmpty() else lookup(more)


def text_digest() -> Column:
    """With the id, tells rows apart that repeat it."""
    return F.xxhash64(F.lit(3), text_of())


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(key, text, line_drops array<long>): for each id and text digest the hashes of the lines that it loses."""
    prepare(docs.sparkSession)
    key_of = lambda x: ascii_lower(F.btrim(x, F.lit(BLANK)))
    keys = F.array_distinct(F.filter(F.transform(F.split(text_of(), "\n", -1), key_of), lambda k: F.length(k) >= min_chars))
    hashed = F.transform(keys, lambda k: F.struct(line_hash(k).alias("h"), line_fingerprint(k).alias("fp")))
    lines = saved(docs.select(id_key().alias("key"), text_digest().alias("text"), F.inline(hashed)), "lines")
    keyed = saved(counted_lines(lines), "distinct_lines")
    n_shards = max(1, -(-keyed.count() // SHARD_KEYS))
    shard = F.pmod(F.shiftrightunsigned("h", 32), F.lit(n_shards)).cast("int")
    shards = saved(keyed.groupBy(shard.alias("shard")).applyInPandas(shard_rows, SHARD_SCHEMA), "shards")
    # lines of one document weigh nothing in a shard's load but their own probe
    usual, hot = copies_of(keyed.filter("n_docs > 1").select(shard.alias("shard"), "n_docs"), lines.count(), n_shards)
    salted = lambda rows: rows.withColumn("salts", F.lit(usual)) if hot is None else rows.join(hot, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(usual)))
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    arrays = salted(shards).select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *[F.lit(0).cast("long").alias(c) for c in ("key", "text", "h")], F.lit(0).alias("fp"), *HELD)
    probes = salted(lines.withColumn("shard", shard)).select("shard", F.pmod(F.xxhash64("key", "text"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "text", "h", "fp", *none(*HELD))
    out = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInPandas(probe, "key long, text long, h long")
    return out.groupBy("key", "text").agg(F.collect_set("h").alias("line_drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, the columns in `keep`, n_lines, n_dropped, kept_text."""
    drops = dropped_lines(docs, min_chars).withColumnsRenamed({"key": "line_key", "text": "line_digest"})
    key_of = lambda x: line_hash(ascii_lower(F.btrim(x, F.lit(BLANK))))
    rows = docs.select(id_key().alias("line_key"), text_digest().alias("line_digest"), *[F.col(c).alias(f"keep_{c}") for c in keep], text_of().alias("line_text"))
    rows = rows.join(drops, ["line_key", "line_digest"], "left").drop("line_digest")
    hashes = F.when(F.size("line_drops") > 0, F.transform(F.split("line_text", "\n", -1), key_of))
    rows = rows.withColumn("line_hashes", hashes)
    kept = [f for f in rows.schema if f.name.startswith("keep_")]
    schema = ", ".join(["line_key long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_lines long, n_dropped long, kept_text string"])
    out = rows.mapInPandas(rebuild, schema)
    return out.select(id_back("line_key").alias("doc_id"), *[F.col(f"keep_{c}").alias(c) for c in keep], "n_lines", "n_dropped", "kept_text")


def op10(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS f FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, r.f IS NOT NULL AND r.f <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
