import io
import json

import pyarrow.parquet as pq
import pytest

from seekframe import serve
from seekframe.functions import analysis
from seekframe.operators import bm25
from seekframe.operators import index as ix
from seekframe.options import EngineOptions
from seekframe.plans.measure import percentiles
from seekframe.plans.search import Engine
from seekframe.sources import jsonl, store
from seekframe.sources.synthetic import sentences, synthesize

DOCS = "ext_id string, url string, title string, body string, tags string"
TEXTS = [("a", "", "Foxes", "a fox and a fox", "x"), ("b", "", "", "the fox", ""), ("c", "", "Owls fox", "", "fox"), ("d", "", "none", "nothing here", ""), ("e", "", None, None, None)]


@pytest.mark.parametrize("options", [EngineOptions(), EngineOptions(k1=0.0, b=1.0), EngineOptions(b=0.0)])
def test_scan_scores_are_those_of_the_tables(spark, options):
    docs = spark.createDataFrame([(i, *r[2:]) for i, r in enumerate(TEXTS)], "doc_id int, title string, body string, tags string")
    rows = ix.by_field(docs)
    lens = ix.lengths(rows)
    queries = [{"fox": 1.0}, {"fox": 2.0, "owls": 1.0, "zzz": 1.0}]
    got = {r.doc_id: r.scores for r in bm25.scanned(docs, queries, options).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for i, query in enumerate(queries):
        want = {r.doc_id: r.score for r in bm25.scores(ix.postings(rows), lens, ix.field_stats(lens), query, options).collect()}
        assert {d: s[i] for d, s in got.items() if s[i]} == pytest.approx(want)


def test_scan_scores_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id int, title string, body string, tags string")
    assert bm25.scanned(docs, [{"fox": 1.0}]).collect() == []
    some = spark.createDataFrame([(1, "fox", "", "")], docs.schema)
    assert [r.scores for r in bm25.scanned(some, [{}, {}]).collect()] == [[0.0, 0.0]]


def test_a_changed_table_is_not_trusted(spark, tmp_path):
    path = str(tmp_path / "store")
    Engine.build(spark.createDataFrame(TEXTS, DOCS), EngineOptions(mining=False)).save(path)
    assert Engine.restore(spark, path).search("owls", "bm25").total == 1
    facts = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    assert facts["checksums"]["docs"][0] == len(TEXTS)
    folder = tmp_path / "store" / facts["folder"] / "lengths"
    file = next(f for f in sorted(folder.glob("*.parquet")) if pq.read_metadata(f).num_rows)
    held = pq.read_table(file)
    at = held.column_names.index("len")
    pq.write_table(held.set_column(at, held.schema.field(at), [[x + 1 for x in held["len"].to_pylist()]]), file)
    (folder / f".{file.name}.crc").unlink()
    with pytest.raises(store.StaleStore, match="lengths"):
        Engine.restore(spark, path)
    assert Engine.restore(spark, path, verify=False).tables["docs"].count() == len(TEXTS)
    file.write_bytes(b"no parquet")
    with pytest.raises(store.StaleStore, match="lengths"):
        Engine.restore(spark, path)


def test_checksum_knows_repeated_rows_and_no_order(spark):
    one = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    assert store.checksum(one) == store.checksum(one.orderBy("b").select("b", "a")) != store.checksum(one.distinct())
    assert store.checksum(one.limit(0)) == [0, "0"]


def test_manifest_reads_what_is_there(spark, tmp_path):
    with pytest.warns(UserWarning, match="manifest.txt"):
        assert jsonl.read_manifest(spark, str(tmp_path)).count() == 0
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text('{"title":"no id"}\n{"id":"-%s","title":"t"}\n' % name)
    (tmp_path / "manifest.txt").write_text("two.jsonl\n# x\none.jsonl\nthree.jsonl\n")
    with pytest.warns(UserWarning, match="three.jsonl"):
        rows = jsonl.read_manifest(spark, str(tmp_path))
    assert sorted(r.ext_id for r in rows.collect()) == ["-one", "-two", "one-1", "two-1"]


def test_dictionary_keeps_letters_from_u3000(spark):
    lines = spark.createDataFrame([("ÀB ꭰꮀ Ꭰ",), ("ＡＢ",)], "value string")
    assert sorted(r.word for r in analysis.dictionary_words(lines).collect()) == sorted(analysis.normalize_entry(x) for x in ("ÀB", "ꭰꮀ", "Ꭰ", "ＡＢ"))


SEEDS = [("s1", "", "甲", "第一个句子足够长了吧。短。第二个句子也足够长了！", "t"), ("s2", "", "乙", "第三个句子同样足够长了？尾巴没有句号但是也很长", ""), ("s3", "", "丙", None, "u")]


def test_synthetic_corpus(spark):
    seeds = spark.createDataFrame(SEEDS, DOCS)
    pool = {r.sentence for r in sentences(seeds).collect()}
    assert len(pool) == 4 and all(len(x) > 8 for x in pool)
    rows = synthesize(seeds, 60).collect()
    assert sorted(r.ext_id for r in rows) == sorted(f"bench-{i}" for i in range(60))
    assert {len(r.body.split("\n\n")) for r in rows} == {2, 3, 4} and {r.title[0] for r in rows} == set("甲乙丙")
    assert all(r.title.endswith(f"（变体 {r.ext_id[6:]}）") for r in rows)
    for r in rows:
        for paragraph in r.body.split("\n\n"):
            assert sum(paragraph.count(x) for x in pool) in (2, 3, 4)
    assert sorted(map(tuple, synthesize(seeds.repartition(3), 60).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, synthesize(seeds, 60, 8).collect())) != sorted(map(tuple, rows))
    assert synthesize(seeds.filter("ext_id = 's3'"), 5).count() == 0


def test_bench_and_regold_commands(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": r[0], "title": r[2], "body": r[3] or ""}) + "\n" for r in SEEDS))
    target = tmp_path / "bench.json"
    assert serve.main(["bench", "句子", "--corpus", str(tmp_path), "--docs", "20", "--repetitions", "1", "--out", str(target), "--no-mining"], spark, io.StringIO()) == 0
    got = json.loads(target.read_text())
    assert got["documents"] == 20 and got["build_seconds"] > 0 and set(got["latency_ms"]) == {"bm25", "hybrid"} and set(got["stage_seconds"]) == {"mining", "index", "vectors"}
    gold, words = tmp_path / "gold.txt", tmp_path / "words.txt"
    gold.write_text("# cuts\n\n风车转得很快\told\n")
    words.write_text("风车\n")
    out = io.StringIO()
    assert serve.main(["regold", str(gold), "--dict", str(words)], spark, out) == 0 and out.getvalue() == "1 sentences cut\n"
    assert gold.read_text() == "# cuts\n\n风车转得很快\t风车 转 得 很 快\n"


def test_percentiles():
    assert percentiles([3.0, 1.0, 2.0], 50, 95, 100) == [2.0, 3.0, 3.0] and percentiles([], 50) == [0.0]
