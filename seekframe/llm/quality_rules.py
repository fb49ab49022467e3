"""Quality rules (7): text statistics, and lines that many documents of one host share.

Per text: words, their characters, symbols, lines equal to an earlier line, words in repeated 3-word windows. A text
fails outright with fewer than 50 words or with more than half of its words in repeated windows.

Lines across documents: a line is normalised (words joined by one blank, lower-cased, digits as 0) and hashed to 64
bits. For each host (the `source` column) distinct documents are counted per line hash; documents of a host that have
the same set of line hashes are one document, so a group of copies does not make its own content a frequent line. A
line is over the limit in a host if it is in more than `MIN_DOCS` documents and in more than `MAX_SHARE` of the host's.
Such lines are removed, and a document left with under `MIN_LEFT` of its words is rejected.

Texts are read once; only hashes are shuffled. Documents are pre-aggregated by (host, set of lines) and lines by (host,
line) before each shuffle, so neither a large host, a group of copies nor a frequent line loads one task. The table of
lines over the limit holds at most 1 / MAX_SHARE lines a host and line of a document's mean; it is broadcast only after
its size is checked, and beyond that both sides are dealt over `SALTS` parts of each line.

A null text has no words and fails. A very long text is one row, measured whole. Null sources are one host. Null ids are
kept; repeated rows are judged each and counted once. There are no ties to break: a limit is passed only from above. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, prepare, saved, text_of

MIN_WORDS, MAX_REPEATED, MIN_DOCS, MAX_SHARE, MIN_LEFT = 50, 0.5, 20, 0.02, 0.4
#: Parts of a line over the limit, where those lines are too many to broadcast.
SALTS = 32
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
DIGITS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<struct<h:bigint,n:int>>, content long"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are in the text at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) < 2_000_000:
        windows = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n + 2, bool)
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    for j in range(3):
        twice[at + j] = True
    return int(twice.sum())


def statistics(text: str) -> tuple:
    import xxhash

    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_dup, seen, lines = 0, set(), {}
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            n_dup += 1
        seen.add(line)
        norm = b" ".join(own).translate(DIGITS)
        h = xxhash.xxh3_64_intdigest(norm) - 2**63
        lines[h] = lines.get(h, 0) + len(own)
    repeated = repeat_words(words)
    n = len(words)
    content = xxhash.xxh3_64_intdigest(np.sort(np.fromiter(lines, np.int64, len(lines))).tobytes()) - 2**63
    failed = n < MIN_WORDS or repeated > MAX_REPEATED * n
    return n, word_chars, sum(text.count(c) for c in SYMBOLS), n_dup, repeated, failed, [{"h": h, "n": k} for h, k in lines.items()], content


def measured(docs: DataFrame) -> DataFrame:
    """row, id, host, the statistics, lines: (hash, words) of each distinct line, content: hash of their set."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in "row id host".split()] + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*x, *statistics(t)) for *x, t in zip(batch["row"], batch["id"], batch["host"], batch["t"])], columns=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text_of().alias("t"))
    return rows.mapInPandas(run, f"row long, id string, host string, {STATS}")


def frequent_lines(found: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h, n_docs): the lines over the limit in each host."""
    distinct = found.filter("n_words > 0").groupBy("host", "content").agg(F.first("lines.h").alias("hs"))
    distinct = saved(distinct, "distinct")
    lines = distinct.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    over = lines.filter(F.col("n_docs") > min_docs).join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("host_docs"))
    return over.select("host", "h", "n_docs")


def judged(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row a document: row, id, the statistics, words_left, kept."""
    found = saved(measured(docs), "measured")
    over = saved(frequent_lines(found).select("host", "h"), "frequent")
    lines = found.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n")
    if over.count() <= broadcast_rows:
        lines = lines.join(F.broadcast(over), ["host", "h"])
    else:
        over = over.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lines = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(over, ["host", "h", "salt"])
    lost = lines.groupBy("row").agg(F.sum("n").alias("lost"))
    out = found.drop("lines", "content").join(lost, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= MIN_LEFT * F.col("n_words"))).drop("lost", "host")


def op7(docs: DataFrame) -> DataFrame:
    return judged(docs).select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
ws AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d),
w AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM ws),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS j FROM tw) GROUP BY r),
ls AS (SELECT r, string_split(t, chr(10)) AS x FROM d),
l AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm FROM (SELECT r, unnest(x) AS line FROM ls)),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY r),
dl AS (SELECT r, norm, any_value(n) AS n, sum(n) AS total FROM l WHERE n > 0 GROUP BY r, norm),
c AS (SELECT DISTINCT host, x FROM (SELECT r, list_sort(list(norm)) AS x FROM dl GROUP BY r) JOIN d USING (r)),
seen AS (SELECT host, norm, count(*) AS n FROM (SELECT host, unnest(x) AS norm FROM c) GROUP BY host, norm),
hosts AS (SELECT host, count(*) AS n FROM c GROUP BY host),
over AS (SELECT host, norm FROM seen JOIN hosts USING (host) WHERE seen.n > 20 AND seen.n > 0.02e0 * hosts.n),
lost AS (SELECT r, sum(total) AS n FROM dl JOIN d USING (r) SEMI JOIN over ON over.host = d.host AND over.norm = dl.norm GROUP BY r),
s AS (SELECT r, doc_id, len(x) AS n_words, coalesce(list_sum(list_transform(x, lambda y: length(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost FROM d JOIN ws USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - lost >= 0.4e0 * n_words AS kept FROM f
"""
