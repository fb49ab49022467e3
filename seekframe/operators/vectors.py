"""Dense vectors: exact and approximate nearest neighbours, centring, pooling, training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(vectors: DataFrame, query: list[float], k: int, exclude=None) -> DataFrame:
    """(doc_id, score): the k vectors of (doc_id, embedding) closest to one query, by score, then id: one scan, no shuffle
    but of k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if exclude is None else vectors.filter(F.col("doc_id") != exclude)
    return rows.select("doc_id", F.round(dot(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


#: Bytes of query vectors that one task holds.
HELD = 64 << 20


def _best_of(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k by score, then id."""
    if len(docs) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        docs, scores = docs[keep], scores[keep]
    at = np.lexsort((docs, -scores))[:k]
    return docs[at], scores[at]


def _best_lists(batches, ids: np.ndarray, matrix: np.ndarray, k: int, block: int) -> Iterator[pd.DataFrame]:
    """The best k of all rows of some batches (doc_id, embedding) for each query: a matrix product a batch and block."""
    held = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
    for batch in batches:
        if not len(batch):
            continue
        docs, x = batch["doc_id"].to_numpy(np.int64), np.stack(batch["embedding"].to_numpy()).astype(np.float64)
        for first in range(0, len(ids), block):
            for j, scores in enumerate(np.round(matrix[first : first + block] @ x.T, 6), first):
                held[j] = _best_of(np.concatenate([held[j][0], docs]), np.concatenate([held[j][1], scores]), k)
    for first in range(0, len(ids), block):
        part = held[first : first + block]
        yield pd.DataFrame({"query_id": np.repeat(ids[first : first + block], [len(d) for d, _ in part]), "doc_id": np.concatenate([d for d, _ in part]), "score": np.concatenate([s for _, s in part])})


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512, held: int = HELD) -> DataFrame:
    """(query_id, doc_id, score, rank from 0) for a stated set of queries (query_id, query), exact.

    If the queries are counted to take at most `held` bytes, every task has them and scans its vectors once. Otherwise
    queries are dealt into sets of about that size and vectors into parts, and each task scans one part for one set, so
    neither the driver nor a task holds all queries. A task keeps the best k of a query over all it scans.
    """
    from pyspark.sql import Window

    rows, asked = vectors.select("doc_id", "embedding"), queries.select("query_id", F.transform("query", lambda x: x.cast("float")).alias("query"))
    size = asked.agg(F.coalesce(F.sum(F.size("query") * 8 + 16), F.lit(0)).alias("size")).first()["size"]
    kinds = "query_id long, doc_id long, score double"
    as_arrays = lambda ids, points: (np.array(ids, np.int64), np.stack(points).astype(np.float64))
    if not size:
        return rows.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if size <= held:
        found = asked.orderBy("query_id").collect()
        ids, matrix = as_arrays([r["query_id"] for r in found], [r["query"] for r in found])
        out = rows.mapInPandas(lambda batches: _best_lists(batches, ids, matrix, k, block), kinds)
    else:
        spark = rows.sparkSession
        sets, total = -(-size // held), rows.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0)).alias("size")).first()["size"]
        parts = max(1, -(-total // held), int(spark.conf.get("spark.sql.shuffle.partitions")) // sets)
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1))).alias(name)
        dealt = lambda key, n, name: F.pmod(F.xxhash64(key), F.lit(int(n))).cast("int").alias(name)

        def pair(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(wanted):
                return pd.DataFrame({"query_id": np.empty(0, np.int64), "doc_id": np.empty(0, np.int64), "score": np.empty(0)})
            return pd.concat(_best_lists([own], *as_arrays(wanted["query_id"], wanted["query"].to_numpy()), k, block))

        left = rows.select(dealt("doc_id", parts, "part"), every(sets, "set"), "doc_id", "embedding").groupBy("part", "set")
        right = asked.select(every(parts, "part"), dealt("query_id", sets, "set"), "query_id", "query").groupBy("part", "set")
        out = left.cogroup(right).applyInPandas(pair, kinds)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).withColumn("rank", F.col("place") - 1).drop("place")


def center(vectors: DataFrame) -> DataFrame:
    """(i, mean): the mean of every dimension."""
    return vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centered(vectors: DataFrame) -> DataFrame:
    """(doc_id, embedding): the mean is subtracted and the length made 1."""
    mean = F.broadcast(center(vectors).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("m")))  # one row
    return vectors.join(mean).select("doc_id", normalized(F.zip_with("embedding", "m", lambda a, b: a.cast("double") - b)).alias("embedding"))


def pooled(postings_tf: DataFrame, word_vectors: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, i, value): tf-idf weighted sums of word vectors. postings_tf: (doc_id, term, tf); word_vectors: (term,
    vector); one of them has df, too."""
    weight = (1 + F.log(F.col("tf"))) * (F.log(F.lit(float(n_docs)) / F.col("df")) + 1)
    rows = postings_tf.join(word_vectors, "term").select("doc_id", weight.alias("w"), F.posexplode("vector").alias("i", "x"))
    return rows.groupBy("doc_id", "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("value"))


#: Words that get a vector; each worker of the training holds all of their vectors.
VOCABULARY = 30_000


def vocabulary(sentences: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(term, df): the terms of most rows (terms array<string>), ties by term, up to size."""
    rows = sentences.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rows.orderBy(F.desc("df"), "term").limit(size)


def train_word_vectors(sentences: DataFrame, dimension: int = 120, window: int = 5, min_count: int = 1, iterations: int = 1, seed: int = 42, size: int = VOCABULARY) -> DataFrame:
    """(term, vector): skip-gram word vectors of (terms array<string>) rows, trained by MLlib, distributed over partitions.
    Only the terms of `vocabulary` count."""
    from pyspark.ml.feature import Word2Vec

    known = [r["term"] for r in vocabulary(sentences, size + 1).collect()]  # bounded by size
    if len(known) > size:
        listed = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in known[:size])
        sentences = sentences.select(F.expr(f"filter(terms, t -> t IN ({listed}))").alias("terms"))  # a hash set in the JVM

    model = Word2Vec(vectorSize=dimension, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, inputCol="terms", outputCol="v").fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vector"))


def nearest_words(word_vectors: DataFrame, term: str, k: int) -> DataFrame:
    """(term, score): the words with the largest dot product with a word's vector; itself is left out."""
    own = word_vectors.filter(F.col("term") == term).first()
    if own is None:
        return word_vectors.select("term", F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in own["vector"]])
    return word_vectors.filter(F.col("term") != term).select("term", F.round(dot(F.col("vector"), q), 6).alias("score")).orderBy(F.desc("score"), "term").limit(k)


class GraphIndex:
    """Approximate neighbours by layered navigable small-world graphs, one a shard.

    Vectors are dealt to shards by id hash; each shard builds its own graphs in one task (bounded by the shard's size): all
    of its rows in the lowest layer, and of each layer about one in `m` in the next. They are kept as rows (shard, ids,
    vectors, size, links, upper, entry), persisted or, by `save`, written, so searches don't build them again. A query
    descends the layers of every shard and ends with a best-first search of the lowest; the shards' lists are merged.
    """

    SCHEMA = "shard int, ids binary, vectors binary, size int, links binary, upper array<struct<rows:binary,links:binary>>, entry int"

    def __init__(self, table: DataFrame, dimension: int) -> None:
        self.table, self.dimension = table, dimension

    @staticmethod
    def build(vectors: DataFrame, dimension: int, shard_rows: int = 20_000, m: int = 16, ef: int = 100, seed: int = 7) -> "GraphIndex":
        n_shards = max(1, -(-vectors.count() // shard_rows))

        def graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("doc_id")
            x = np.stack(rows["embedding"].to_numpy()).astype(np.float32)
            links, entry = _build_graph(x, m, ef, seed)
            levels, upper = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(m)).astype(int), []
            for level in range(1, levels.max() + 1):
                own = np.flatnonzero(levels >= level).astype(np.int32)
                above, at = _build_graph(x[own], m, ef, seed + level)
                upper.append({"rows": own.tobytes(), "links": above.tobytes()})
                entry = int(own[at])
            return pd.DataFrame({"shard": [key[0]], "ids": [rows["doc_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "size": [len(x)], "links": [links.tobytes()], "upper": [upper], "entry": [entry]})

        shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")
        return GraphIndex(vectors.groupBy(shard.alias("shard")).applyInPandas(graph, GraphIndex.SCHEMA).persist(StorageLevel.MEMORY_AND_DISK), dimension)

    def save(self, path: str) -> "GraphIndex":
        """Write the graphs and go on with the written ones."""
        self.table.write.parquet(path)
        self.table.unpersist()
        return GraphIndex(self.table.sparkSession.read.schema(self.table.schema).parquet(path), self.dimension)

    def search(self, queries: list[tuple[int, list[float]]], k: int, ef: int = 64) -> DataFrame:
        """(query_id, doc_id, score, rank from 0)."""
        from pyspark.sql import Window

        dimension, ids = self.dimension, [q for q, _ in queries]
        points = np.array([v for _, v in queries], np.float32)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    x = np.frombuffer(row.vectors, np.float32).reshape(row.size, dimension)
                    links, own = np.frombuffer(row.links, np.int32).reshape(row.size, -1), np.frombuffer(row.ids, np.int64)
                    upper = [(rows, x[rows], np.frombuffer(u["links"], np.int32).reshape(len(rows), -1)) for u in reversed(list(row.upper)) for rows in [np.frombuffer(u["rows"], np.int32)]]
                    for q, v in zip(ids, points):
                        at = row.entry
                        for rows, points_of, links_of in upper:
                            at = int(rows[_walk(points_of, links_of, int(np.searchsorted(rows, at)), v, 1)[0][1]])
                        found = _walk(x, links, at, v, max(ef, k))[:k]
                        yield pd.DataFrame({"query_id": q, "doc_id": own[[i for _, i in found]], "score": [round(float(s), 6) for s, _ in found]})

        found = self.table.mapInPandas(walk, "query_id long, doc_id long, score double")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).withColumn("rank", F.col("place") - 1).drop("place")


def _walk(x: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
    """Best-first search: (score, row), best first."""
    import heapq

    start = float(x[entry] @ q)
    seen, todo, best = {entry}, [(-start, entry)], [(start, entry)]
    while todo:
        s, at = heapq.heappop(todo)
        if len(best) >= ef and -s < best[0][0]:
            break
        new = [i for i in links[at].tolist() if i >= 0 and i not in seen]
        seen.update(new)
        for i, score in zip(new, (x[new] @ q).tolist() if new else ()):
            if len(best) < ef or score > best[0][0]:
                heapq.heappush(todo, (-score, i))
                heapq.heappush(best, (score, i))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted(best, key=lambda y: (-y[0], y[1]))


def _build_graph(x: np.ndarray, m: int, ef: int, seed: int) -> tuple[np.ndarray, int]:
    """Links of every row (up to 2m, -1 where fewer) in insertion order of a seeded shuffle."""
    n, cap = len(x), 2 * m
    links, degree = np.full((n, cap), -1, np.int32), np.zeros(n, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    entry = int(order[0])
    for at in order[1:].tolist():
        for _, other in _walk(x, links, entry, x[at], ef)[:m]:
            for a, b in ((at, other), (other, at)):
                if degree[a] < cap:
                    links[a, degree[a]] = b
                    degree[a] += 1
                else:  # the farthest makes room, but a link that is its owner's only way in stays
                    scores = x[links[a]] @ x[a]
                    worst = int(scores.argmin())
                    if x[b] @ x[a] > scores[worst] and degree[links[a, worst]] > 1:
                        links[a, worst] = b
    return links, entry
