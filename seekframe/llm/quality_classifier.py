"""Quality classifier (9): document evidence with host and path posteriors by hierarchical empirical Bayes.

1. Evidence: a logistic regression over `FEATURES` of the text, fitted to the labelled documents (a share of the
   distinct rows by hash, of about `SAMPLE_ROWS`; a bound on the fit only). Every document gets a log-odds.
2. Global prior: the mean evidence of all documents. Host level (`source`) and path level (`source`, `lang`): grouped
   aggregation gives each group's number and sum of evidence; its posterior mean is (strength * parent + sum) /
   (strength + n), where the parent of a path is its host's posterior and of a host the global prior. The strength of a
   level is estimated from the groups by the method of moments: groups that differ no more than chance would have them
   are pulled wholly to their parent, and so are groups with few documents.
3. A document's prior is the posterior of its path without the document itself: its evidence is taken out of path, host
   and global sums, so that it does not count twice on a sparse path. (The strengths are those of all documents.)
4. Its score is its evidence with the odds of its prior in place of the global ones. Kept: score >= 0.5, ties included.

Groups are aggregated before the shuffle, so a host with a third of all rows is a few partial rows a task. The group
tables are broadcast only after a size check.

A null or empty text has the features of an empty text and is judged by them; a very long text is one row, measured
whole. Null sources or languages are groups of their own. Null ids are judged without labels. Repeated rows are judged
each; in the fit, rows of equal id and content count once. Without labels of both kinds the evidence is 0.5 and all
documents are kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lookup, prepare, saved, text_of
from .quality_rules import repeat_words

SAMPLE_ROWS, PENALTY, LEAST_STRENGTH, MOST_STRENGTH = 20_000, 1e-2, 20.0, 1e6
FEATURES = ("log_words", "word_length", "long_words", "symbols", "bars", "punctuation", "digits", "capitals", "repeated", "distinct", "top_word", "line_words", "double_lines", "sentences", "non_ascii")
SYMBOLS = b"#*$%&<>@^~=+_{}[]\\/"


def features(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    counts = np.unique(np.array([hash(w) for w in words], np.int64), return_counts=True)[1] if words else np.array([0])
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / n),
        sum(len(w) > 14 for w in words) / n,
        math.sqrt(sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))) / n),
        math.sqrt(data.count(b"|") / n),
        math.sqrt(sum(data.count(x) for x in (b".", b",", b";", b":", b"!", b"?")) / n),
        math.sqrt(sum(data.count(b"%d" % i) for i in range(10)) / size),
        math.sqrt(sum(w[:1].isupper() for w in words) / n),
        repeat_words(words) / n,
        len(counts) / n,
        float(counts.max()) / n,
        math.log1p(len(words) / max(1, len(lines))),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        math.sqrt(data.count(b". ") / n),
        math.sqrt((len(data) - len(text)) / size),
    ]


def group_of(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def row_digest() -> Column:
    """64-bit hash of all that a document is judged by; with the id it finds the judged row again."""
    return F.xxhash64(text_of(), group_of("source"), group_of("lang"))


def featured(docs: DataFrame) -> DataFrame:
    """row, id, host, path, digest and the features x of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="t").assign(x=[features(t) for t in batch["t"]])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), group_of("source").alias("host"), F.concat(group_of("source"), F.lit("/"), group_of("lang")).alias("path"), row_digest().alias("digest"), text_of().alias("t"))
    return rows.mapInPandas(run, "row long, id long, host string, path string, digest long, x array<double>")


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights of a ridge logistic regression on standardised features, by Newton's steps."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, np.zeros(len(FEATURES))
    x = np.column_stack([x, x**2])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], PENALTY * len(y))
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return float(w[0] - weights @ mean), weights


def train(rows: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray]:
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("y"))
    labelled = saved(rows.join(known, "id").groupBy("id", "digest").agg(F.first("x").alias("x"), F.first("y").alias("y")), "labelled")
    # a share of the rows by hash that has about SAMPLE_ROWS of them: one filter, no sort; rows of one id are dealt by content
    share = min(2**30, 2**30 * SAMPLE_ROWS // max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.xxhash64("id", "digest"), F.lit(2**30)) < share).orderBy("id", "digest").select(F.col("x").cast("array<float>").alias("x"), "y").toPandas()
    return fit(np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float))


def log_odds(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def strength(groups: DataFrame) -> float:
    """Prior observations of a level, by moments. groups: n, mean, parent (posterior mean of the level above)."""
    total = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("parent"), 2)).alias("between"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent"))).alias("spread"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not total["n"] or not total["spread"] or total["k"] < 2:
        return MOST_STRENGTH
    within = total["spread"] / total["n"]
    # E[sum n (mean - parent)^2] = k * within * (1 - r) + n * within * r, with r = 1 / (1 + strength)
    r = (total["between"] / within - total["k"]) / (total["n"] - total["k"]) if total["n"] > total["k"] else 0.0
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / r - 1))) if r > 0 else MOST_STRENGTH


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, id, digest, evidence, host_posterior, path_posterior, prior, score, kept for every row of docs."""
    rows = saved(featured(docs), "features")
    bias, weights = train(rows, labels)
    return scored(rows, bias, weights)


def scored(rows: DataFrame, bias: float, weights: np.ndarray) -> DataFrame:
    if len(weights) == len(FEATURES):
        weights = np.concatenate([weights, np.zeros(len(FEATURES))])
    value = F.lit(bias)
    for i in range(len(FEATURES)):
        value = value + F.col("x")[i] * float(weights[i]) + F.col("x")[i] * F.col("x")[i] * float(weights[len(FEATURES) + i])
    rows = saved(rows.select("row", "id", "digest", "host", "path", (1 / (1 + F.exp(-F.greatest(F.least(value, F.lit(30.0)), F.lit(-30.0))))).alias("evidence")), "evidence")
    paths = saved(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("sum")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).first()
    prior = float(total["sum"] / total["n"]) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).withColumns({"mean": F.col("sum") / F.col("n"), "parent": F.lit(prior)})
    by_host = strength(hosts)
    posterior = lambda s, parent, total, n: (F.lit(s) * parent + total) / (F.lit(s) + n)
    hosts = saved(hosts.select("host", F.col("n").alias("host_n"), F.col("sum").alias("host_sum"), posterior(by_host, F.lit(prior), F.col("sum"), F.col("n")).alias("host_posterior")), "hosts")
    paths = paths.join(hosts, "host").withColumns({"mean": F.col("sum") / F.col("n"), "parent": F.col("host_posterior")})
    by_path = strength(paths)
    paths = saved(paths.select("path", "n", "sum", "host_n", "host_sum", "host_posterior", posterior(by_path, F.col("parent"), F.col("sum"), F.col("n")).alias("path_posterior")), "posteriors")
    e, every = F.col("evidence"), F.lit(float(total["n"] or 0))
    others = F.when(every > 1, (F.lit(float(total["sum"] or 0)) - e) / (every - 1)).otherwise(F.lit(0.5))
    own = posterior(by_path, posterior(by_host, others, F.col("host_sum") - e, F.col("host_n") - 1), F.col("sum") - e, F.col("n") - 1)
    out = rows.join(lookup(paths), "path").withColumns({"prior": own, "others": others})
    out = out.withColumn("score", 1 / (1 + F.exp(-(log_odds(e) + log_odds(F.col("prior")) - log_odds(F.col("others"))))))
    return out.select("row", "id", "digest", "evidence", "host_posterior", "path_posterior", "prior", "score", (F.col("score") >= 0.5).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import documents

    out = classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(F.col("id").alias("doc_id"), "evidence", "host_posterior", "path_posterior", "prior", "score", "kept")
