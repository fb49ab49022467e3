import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.operators import evaluation, vectors
from seekframe.streaming.ingest import new_urls


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(3).integers(-3, 4, (300, 5)).astype(float)  # small integers: many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("held", [1 << 20, 500])
@pytest.mark.parametrize("block", [4, 512])
def test_batches_of_queries_are_exact(points, held, block):
    x, rows = points
    asked = rows.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in vectors.nearest_batch(rows, asked, 6, block, held).collect()}
    assert len(got) == 6 * len(range(0, 300, 7))
    for q in range(0, 300, 7):
        scores = x @ x[q]
        assert [got[q, r] for r in range(6)] == [(i, scores[i]) for i in np.lexsort((np.arange(300), -scores))[:6]]


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_batches_of_few_or_no_rows(points, held):
    _, rows = points
    asked = rows.filter("doc_id < 2").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    assert vectors.nearest_batch(rows.filter("doc_id < 4"), asked, 10, held=held).count() == 8
    assert vectors.nearest_batch(rows, asked.limit(0), 10, held=held).count() == 0
    assert vectors.nearest_batch(rows.limit(0), asked, 10, held=held).count() == 0


def test_judged_lists_are_measured_as_pairs(spark):
    ranked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 10, 0)], "query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 13), (2, 12)], "query_id int, doc_id int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    judged = ranked.withColumn("hit", (F.col("doc_id") == 11).cast("int"))
    wanted = spark.createDataFrame([(1, 2), (2, 1)], "query_id int, n_rel int")
    a, b = evaluation.per_query(ranked, relevant, asked, 2), evaluation.per_judged(judged, wanted, asked, 2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_vectors_of_the_commonest_words(spark):
    rows = spark.createDataFrame([(["a", "b", "it's"],), (["a", "it's", "it's"],), (["a", "c"],)], "terms array<string>")
    assert [tuple(r) for r in vectors.vocabulary(rows, 3).collect()] == [("a", 3), ("it's", 2), ("b", 1)]
    assert {r.term for r in vectors.train_word_vectors(rows, 4, size=2).collect()} == {"a", "it's"}
    words = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.5, 0.5]), ("z", [0.5, -1.0])], "term string, vector array<double>")
    assert [tuple(r) for r in vectors.nearest_words(words, "x", 2).collect()] == [("y", 0.5), ("z", 0.5)]
    assert vectors.nearest_words(words, "none", 2).count() == 0


@pytest.mark.parametrize("timed", [False, True])
def test_stream_of_new_urls(spark, tmp_path, timed):
    rows = [("http://A.example/x/", "2024-01-01 00:00:00"), ("http://a.example/x", "2024-01-01 00:00:01"), ("http://a.example/y#z", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "url string, at string").coalesce(1).write.parquet(str(tmp_path / "in"))
    urls = spark.readStream.schema("url string, at string").parquet(str(tmp_path / "in")).withColumn("at", F.col("at").cast("timestamp"))
    out = new_urls(urls, "at" if timed else None)
    writer = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
    writer.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.normal for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["http://a.example/x", "http://a.example/y"]
