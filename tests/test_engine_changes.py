"""Changes laid over an index against an index built anew, the last row of an id, graphs inside the engine."""

import random

import numpy as np
import pytest

from seekframe.operators import vectors
from seekframe.options import EngineOptions
from seekframe.plans.search import Engine

DOCS = "ext_id string, url string, title string, body string, tags string"
PLAIN = EngineOptions(mining=False)


def test_the_last_row_of_an_id_wins(spark):
    rows = [("a", "", "", "zebra old", ""), ("b", "", "", "other", ""), ("a", "", "", "apple new", "")]
    e = Engine.build(spark.createDataFrame(rows, DOCS).coalesce(1), PLAIN)
    assert e.search("zebra", "bm25").total == 0 and e.search("apple", "bm25").total == 1
    dated = spark.createDataFrame([(*r, s) for r, s in zip(rows, (5, 1, 2))], DOCS + ", seq int").repartition(3)
    assert Engine.build(dated, PLAIN).search("zebra", "bm25").total == 1


def test_changes_equal_an_index_built_anew(spark):
    rng, live = random.Random(17), {}
    text = lambda: " ".join(rng.choices("red green blue sun moon sky sea 风车".split(), k=rng.randint(0, 9)))
    live = {str(i): text() for i in range(12)}
    row = lambda i: (i, "", live[i][:5], live[i], "t")
    engine = Engine.build(spark.createDataFrame([row(i) for i in live], DOCS), PLAIN, ["风车"])
    for step in range(4):
        changed = [str(rng.randrange(16)) for _ in range(3)]
        live |= {i: text() for i in changed}
        engine = engine.upsert(spark.createDataFrame([row(i) for i in sorted(set(changed))], DOCS))
        dropped = [i for i in sorted(live) if rng.random() < 0.1]
        engine = engine.delete(dropped)
        for i in dropped:
            del live[i]
    assert engine.depth == 8
    anew = Engine.build(spark.createDataFrame([row(i) for i in live], DOCS), PLAIN, ["风车"])
    for query in ("sun sea", "风车", "red red moon"):
        for phrase in (False, True):
            one, two = ({r.id: r.score for r in x.search(query, "bm25", 100, phrase=phrase).hits.collect()} for x in (engine, anew))
            assert one == pytest.approx(two)
    assert engine.tables["field_stats"].orderBy("field").collect() == anew.tables["field_stats"].orderBy("field").collect()


def test_layers_are_built_anew_after_so_many_changes(spark):
    e = Engine.build(spark.createDataFrame([("a", "", "", "one", "")], DOCS), EngineOptions(mining=False, layers=1))
    e = e.upsert(spark.createDataFrame([("b", "", "", "two", "")], DOCS)).upsert(spark.createDataFrame([("c", "", "", "three", "")], DOCS))
    assert e.depth == 0 and e.tables["docs"].count() == 3 and e.search("three", "bm25").total == 1


def test_graphs_inside_the_engine(spark, tmp_path):
    rng = random.Random(2)
    kinds = {"f": "apple pear plum grape fig", "m": "iron zinc lead gold tin", "c": "red blue green pink grey"}
    rows = [(f"{k}{i}", "", "", " ".join(rng.choices(words.split(), k=30)), "") for k, words in kinds.items() for i in range(60)]
    options = EngineOptions(force_vectors=True, dimension=16, mining=False, pool=20)
    docs = spark.createDataFrame(rows, DOCS)
    graph = Engine.build(docs, EngineOptions(**{**options.__dict__, "knn": "graph"}))
    assert graph.stats()["knn"] == "graph"
    v = graph.tables["vectors"].orderBy("doc_id").first()["embedding"]
    exact = {r.doc_id for r in vectors.nearest(graph.tables["vectors"], v, 20).collect()}
    near = {r.doc_id for r in vectors.GraphIndex(graph.tables["graph"], 16).search([(0, v)], 20).collect()}
    assert len(exact & near) >= 19
    got = [r.id[0] for r in graph.search("plum grape", "vector", 10).hits.collect()]
    assert got.count("f") >= 8
    path = str(tmp_path / "store")
    graph.save(path)
    assert Engine.restore(spark, path, graph.options).stats()["knn"] == "graph"
    more = graph.upsert(spark.createDataFrame([("f999", "", "", "plum grape fig plum grape", "")], DOCS))
    assert more.stats()["knn"] == "exact" and more.tables["vectors"].count() == 181
    assert "f999" in [r.id for r in more.search("plum grape", "vector", 20).hits.collect()]


def test_written_graphs_have_layers_and_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    index = vectors.GraphIndex.build(df, 24, shard_rows=1000, m=12).save(str(tmp_path / "graph"))
    assert all(len(r.upper) >= 1 for r in index.table.select("upper").collect())
    queries = [(q, x[q].tolist()) for q in range(0, 2000, 50)]
    got = index.search(queries, 10, 80).toPandas()
    want = {q: set(np.argsort(-(x @ x[q]), kind="stable")[:10].tolist()) for q, _ in queries}
    assert np.mean([len(set(g.doc_id) & want[q]) / 10 for q, g in got.groupby("query_id")]) >= 0.95
