"""Analysis, index, ranking, engine, sources, streaming and front ends."""

import io
import json
import random
import threading
import urllib.error
import urllib.request
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.functions import analysis, text, web
from seekframe.functions.analysis import Lexicon, tokens
from seekframe.functions.wordpiece import WordPieces
from seekframe.operators import bm25, crawl, evaluation, fusion, mining, thesaurus, vectors
from seekframe.operators import index as ix
from seekframe.options import EngineOptions
from seekframe.plans.search import Engine, mode_of
from seekframe.sources import jsonl, store
from seekframe.streaming import ingest

DOCS = "ext_id string, url string, title string, body string, tags string"
ROWS = [
    ("a", "http://x.example.com/a", "Spark shuffles", "A shuffle moves rows between tasks. 量子纠缠改变通信方式", "engine, data"),
    ("b", "", "Columnar files", "Parquet keeps columns together so a scan reads few bytes", "data"),
    ("c", "", "量子纠缠的原理", "我们研究量子纠缠的原理，并解释量子纠缠现象", "physics"),
    ("d", "", "Search engines", "A search engine ranks rows by BM25; shuffle moves nothing here", "engine"),
    ("e", "", "", "", ""),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.build(spark.createDataFrame(ROWS, DOCS), words=["量子", "纠缠", "量子纠缠", "原理", "研究", "解释", "现象"])


def test_runs_numbers_and_folding():
    terms = lambda s: [t["term"] for t in Lexicon().analyze(s)]
    assert terms("k1 costs 3.14 or 1,000.5, café ＡＢＣ") == ["k", "1", "costs", "3.14", "or", "1,000.5", "caf", "abc"]
    found = Lexicon(["风车"]).analyze("Ab风车，9")
    assert [(t["term"], t["start"], t["end"], t["position"]) for t in found] == [("ab", 0, 2, 0), ("风车", 2, 4, 1), ("9", 5, 6, 2)]
    assert [t["position"] for t in Lexicon(["风车"]).analyze("的风车了风车", True)] == [0, 1]


def test_cut_is_lossless_and_prefers_fewer_words():
    lex = Lexicon(["研究", "研究生", "生命", "起源", "命"])
    assert lex.cut("研究生命起源") == ["研究", "生命", "起源"]
    rng = random.Random(1)
    for _ in range(200):
        run = "".join(rng.choice("研究生命起源的") for _ in range(rng.randint(1, 12)))
        assert "".join(lex.cut(run)) == run == "".join(lex.forward(run)) == "".join(lex.backward(run))


def test_tokens_of_mixed_rows(spark):
    rows = spark.createDataFrame([(1, "One two"), (2, "学习Spark很快"), (3, None)], "id int, t string")
    got = {(r.id, r.position): r.term for r in tokens(rows, "t", ["id"], Lexicon(["学习", "很快"])).collect()}
    assert got == {(1, 0): "one", (1, 1): "two", (2, 0): "学习", (2, 1): "spark", (2, 2): "很快"}
    native = spark.createDataFrame([("Two 3.5, the é end",)], "t string").select(analysis.latin_tokens(F.col("t"))).first()[0]
    assert [r.asDict() for r in native] == Lexicon().analyze("Two 3.5, the é end")


def test_dictionary_and_wordpieces(spark):
    lines = spark.createDataFrame([("# no",), ("Ａpple，风车 风车",), ("x #y",)], "value string")
    assert sorted(r.word for r in analysis.dictionary_words(lines).collect()) == ["apple", "x", "风车"]
    wp = WordPieces(["[UNK]", "", "[CLS]", "[SEP]", "play", "##ing", "风", "!"])
    assert wp.encode("Playing风! zzz") == ([1, 3 - 1, 2][:1] + [3, 4, 5, 6, 2], [1] * 6)


def test_random_changes_against_brute_force(spark):
    rng, live, log_rows = random.Random(7), {}, []
    for seq in range(120):
        i = rng.randint(0, 20)
        if rng.random() < 0.3:
            live.pop(i, None)
            log_rows.append((str(i), seq, True, ""))
        else:
            live[i] = " ".join(rng.choices("red green blue sun moon sky sea".split(), k=rng.randint(0, 12)))
            log_rows.append((str(i), seq, False, live[i]))
    log_df = spark.createDataFrame([(i, s, d, "", "", b, "") for i, s, d, b in log_rows], "ext_id string, seq int, deleted boolean, url string, title string, body string, tags string")
    docs = ingest.current(log_df).select(F.col("ext_id").cast("int").alias("doc_id"), "title", "body", "tags")
    rows = ix.by_field(docs)
    lens = ix.lengths(rows)
    posts, stats = ix.postings(rows), ix.field_stats(lens)
    got = {r.doc_id: r.score for r in bm25.scores(posts, lens, stats, ["sun", "sea", "sun"]).collect()}
    n, avg, want = len(live), sum(len(b.split()) for b in live.values()) / len(live), Counter()
    for t, w in (("sun", 2), ("sea", 1)):
        df = sum(t in b.split() for b in live.values())
        for i, b in live.items():
            tf = b.split().count(t)
            if tf:
                want[i] += w * log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b.split()) / avg))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    both = {r.doc_id for r in ix.conjunctive(posts, ["sun", "sea"]).collect()}
    assert both == {i for i, b in live.items() if {"sun", "sea"} <= set(b.split())}
    places = {(r.doc_id, r.start) for r in ix.phrase(posts, ["sun", "sea"]).collect()}
    assert places == {(i, k) for i, b in live.items() for k in range(len(b.split()) - 1) if b.split()[k : k + 2] == ["sun", "sea"]}
    assert sorted(r.new_id for r in ix.compacted(docs).collect()) == list(range(n))


def test_mining_finds_the_planted_word(spark):
    rows = [(f"{a}龙舟赛{b}",) for a in "看去办到在想赶聊说爱" for b in "好热很真开完啦呀了吧"]
    words = {r.term for r in mining.mine_words(spark.createDataFrame(rows, "text string"), min_freq=20).collect()}
    assert words == {"龙舟赛"}


def test_thesaurus_bounds_and_expansion(spark):
    rows = spark.createDataFrame([(i, ["car", "engine", f"x{i}", "every"] if i % 2 else ["sea", "ship", "every", f"y{i}"]) for i in range(40)] + [(100 + i, ["z", f"n{i}"]) for i in range(60)], "doc_id int, terms array<string>")
    related = thesaurus.related_terms(thesaurus.related_pairs(rows))
    got = {(r.term, r.related_term) for r in related.collect()}
    assert ("car", "engine") in got and ("sea", "ship") in got and not any("every" in x for x in got)
    assert [(r.term, r.weight) for r in thesaurus.expansion(related, ["car"], 1).collect()] == [("engine", 1)]


def test_vectors_exact_and_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(4).cache()
    queries = [(q, x[q].tolist()) for q in range(0, 600, 10)]
    exact = vectors.nearest_batch(df, spark.createDataFrame(queries, "query_id long, query array<float>"), 10).toPandas()
    want = {q: set(np.lexsort((np.arange(1500), -np.round(x.astype(float) @ x[q].astype(float), 6)))[:10].tolist()) for q, _ in queries}
    assert {q: set(g.doc_id) for q, g in exact.groupby("query_id")} == want
    near = vectors.GraphIndex.build(df, 48, shard_rows=800).search(queries, 10).toPandas()
    assert np.mean([len(set(g.doc_id) & want[q]) / 10 for q, g in near.groupby("query_id")]) >= 0.95
    assert [r.doc_id for r in vectors.nearest(df, x[5].tolist(), 3).collect()][0] == 5
    lengths = vectors.centered(df).select(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert all(abs(v - 1) < 1e-9 for v in lengths)


def test_fusion(spark):
    lists = [spark.createDataFrame([(i, r) for r, i in enumerate(ids)], "doc_id int, rank int") for ids in ([1, 2, 3], [2, 4])]
    got = {r.doc_id: r.score for r in fusion.reciprocal_rank(lists, (1.0,)).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 63, 4: 1 / 62})
    a, b = (spark.createDataFrame(x, "doc_id int, score double") for x in ([(1, 2.0), (2, 4.0)], [(2, 5.0)]))
    assert {r.doc_id: r.score for r in fusion.weighted(a, b, 0.25).collect()} == pytest.approx({1: 0.0, 2: 1.0})


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", d, r) for r, d in enumerate("abcdef")], "query_id string, doc_id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "f"), ("empty", "z")], "query_id string, doc_id string")
    queries = spark.createDataFrame([("q",), ("none",), ("empty",)], "query_id string")
    got = {r.query_id: r for r in evaluation.per_query(ranked, relevant, queries, 5).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].rr) == (0.5, 0.2, 0.5)
    assert got["q"].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert got["none"].recall is None and got["none"].ndcg is None and got["empty"].recall == 0 and got["empty"].precision == 0
    assert evaluation.averaged(evaluation.per_query(ranked, relevant, queries, 5)).first().n == 2


def test_pages(spark):
    html = """<html><head><title>T &amp; t</title><meta name="description" content="About"><script>x("</p>")</script></head><body><!-- <p>no no no no no no</p> -->
    <nav><a href="/one">One</a> <a href='two?x=1'>Two</a> <a href="#z">z</a> <a href="JavaScript:void(0)">v</a></nav>
    <article><h1>Head</h1><p>First paragraph with prose enough.</p><p>Second one, with a <a href="../up">link</a> inside it.</p></article><footer>Copyright someone</footer></body></html>"""
    bare = "<title> </title><h1>Only head</h1><meta content='Described' name='description'><p><a href='/a'>links only here</a></p>"
    rows = {r.page_id: r for r in web.extracted(spark.createDataFrame([(1, "http://h.example.com/d/e/p.html", html), (2, "http://h.example.com", bare), (3, "http://h", None)], "page_id int, url string, html string")).collect()}
    assert rows[1].title == "T & t" and rows[1].description == "About"
    assert rows[1].links == ["http://h.example.com/one", "http://h.example.com/d/e/two?x=1", "http://h.example.com/d/up"]
    assert rows[1].body.startswith("First paragraph with prose enough.\nSecond one") and "no no" not in rows[1].body
    assert (rows[2].title, rows[2].body) == ("Only head", "Described") and (rows[3].title, rows[3].body, rows[3].links) == ("", "", [])
    text_of = spark.createDataFrame([("&amp;lt; &#65;&#x1F600; &nbsp;x",)], "t string").select(web.unescape(F.col("t"))).first()[0]
    assert text_of == "< A😀  x"


def test_urls_robots_and_policy(spark):
    pairs = [("HTTP://Ex.COM:80/a/?b=2&a=1#f", "http://ex.com/a?a=1&b=2"), ("http://x", "http://x"), ("http://x/", "http://x/"), ("https://x//", "https://x/")]
    got = spark.createDataFrame(pairs, "u string, n string").select("n", web.normalized_url(F.col("u")).alias("g")).collect()
    assert all(r.n == r.g for r in got)
    files = spark.createDataFrame([("h.example.com", "User-agent: bad\nDisallow: /\nUser-agent: *\n# c\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.gif$\nDisallow: /p\nDisallow:\n")], "host string, robots_txt string")
    rules = web.robots_rules(files, "seekframe")
    assert rules.count() == 3
    urls = [("http://h.example.com/p/x", False), ("http://h.example.com/p/ok/1", True), ("http://h.example.com/i/a.gif", False), ("http://h.example.com/i/a.gif?q", True), ("http://other.example.com/p", True), ("http://h.example.com", True)]
    allowed = {r.url: r.allowed for r in web.robots_allowed(spark.createDataFrame([(u,) for u, _ in urls], "url string"), rules).collect()}
    assert allowed == dict(urls)
    assert web.url_fingerprint("a") != web.url_fingerprint("b")
    assert web.decoded("汉字".encode("gbk"), None) == "汉字" and web.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and web.decoded(b"\xef\xbb\xbfok", "x") == "ok"


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.url: r.depth for r in crawl.breadth_first(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    times = crawl.schedule(spark.createDataFrame([("http://h/1", 1, 2.0), ("http://h/2", 2, None), ("http://g/1", 3, 0.0)], "url string, seq int, delay double"), 0.5)
    assert {r.url: r["at"] for r in times.collect()} == {"http://h/1": 0.0, "http://h/2": 2.0, "http://g/1": 0.0}


def test_display():
    lex = Lexicon()
    assert text.marked('"A <b> shuffle!"', lex.analyze('"A <b> shuffle!"'), {"shuffle"}) == "&quot;A &lt;b&gt; <em>shuffle</em>!&quot;"
    body = " ".join(["filler"] * 50 + ["hit", "near", "hit"] + ["tail"] * 50)
    shown = text.snippet(body, {"hit"})
    assert shown.count("<em>hit</em>") == 2 and shown.startswith("…") and shown.endswith("…") and text.snippet("", {"x"}) == ""


def test_json_lines(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('# c\n\n{"id":"1","title":"T","body":"B","tags":["x","y"],"extra":1}\n{"title":"no id","tags":"z"}\n{bad\n[1]\n{"id":"e","title":" ","body":""}\n')
    (tmp_path / "manifest.txt").write_text("# files\none.jsonl\n")
    got = sorted(tuple(r) for r in jsonl.read_corpus(spark, str(tmp_path)).collect())
    assert got == [("1", "", "T", "B", "x,y"), ("one-4", "", "no id", "", "z")]
    assert jsonl.read_manifest(spark, str(tmp_path)).count() == 2
    (tmp_path / "q.jsonl").write_text('{"id":"q","query":"a b","relevant":["1"],"kind":"semantic"}\n{"query":"c"}\n')
    queries = jsonl.read_queries(spark, str(tmp_path / "q.jsonl")).collect()
    assert [(q.query_id, q.relevant, q.kind) for q in queries] == [("q", ["1"], "semantic"), ("q2", [], "lexical")]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        jsonl.read_queries(spark, str(tmp_path / "bad.jsonl")).collect()


def test_search_modes(engine):
    ids = lambda **k: [r.id for r in engine.search(**k).hits.collect()]
    assert ids(query="shuffle rows", mode="bm25")[:2] in (["a", "d"], ["d", "a"])
    assert ids(query="量子纠缠", mode="bm25")[0] == "c"
    assert ids(query="moves rows", mode="bm25", phrase=True) == ["a"]
    result = engine.search("shuffle", "hybrid")
    first = result.hits.first()
    assert result.total == len(result.hits.collect()) and first.score == pytest.approx(1 / 61, abs=1e-6) and "<em>" in first.snippet and "bm25" in first.contributions
    assert ids(query="shuffle rows", mode="bm25", top_k=1, offset=1) == [ids(query="shuffle rows", mode="bm25")[1]]
    assert ids(query="zzz", mode="hybrid") == [] and ids(query="shuffle", mode="vector") == []
    assert mode_of("BM25") == "bm25" and mode_of("?") == "hybrid"


def test_changes_give_new_engines(spark, engine):
    more = engine.upsert(spark.createDataFrame([("a", "", "Nothing", "else", ""), ("z", "", "Fresh", "zebra stripes", "")], DOCS))
    assert [r.id for r in more.search("zebra", "bm25").hits.collect()] == ["z"] and more.search("spark", "bm25").total == 0
    less = more.delete(["z"])
    assert less.search("zebra", "bm25").total == 0 and engine.search("spark", "bm25").total == 1
    assert less.tables["docs"].count() == 5


def test_save_and_restore(spark, engine, tmp_path):
    path = str(tmp_path / "store")
    engine.save(path)
    again = Engine.restore(spark, path)
    for mode in ("bm25", "semantic", "hybrid"):
        assert [tuple(r) for r in again.search("量子纠缠 shuffle", mode).hits.collect()] == [tuple(r) for r in engine.search("量子纠缠 shuffle", mode).hits.collect()]
    a, b = again.stats(), engine.stats()
    assert {k: v for k, v in a.items() if k != "stage_seconds"} == {k: v for k, v in b.items() if k != "stage_seconds"}
    with pytest.raises(store.StaleStore):
        Engine.restore(spark, path, EngineOptions(stopwords=True))
    with pytest.raises(store.StaleStore):
        Engine.restore(spark, path, expected={"checksum": 1})


def test_trained_vectors(spark):
    rng = random.Random(2)
    rows = [(f"{kind}{i}", "", "", " ".join(rng.choices(words.split(), k=30)), "") for kind, words in (("f", "apple pear plum grape fig"), ("m", "iron zinc lead gold tin")) for i in range(40)]
    e = Engine.build(spark.createDataFrame(rows, DOCS), EngineOptions(force_vectors=True, dimension=16, mining=False))
    got = [r.id[0] for r in e.search("plum grape", "vector").hits.collect()]
    assert got.count("f") >= 8 and e.search("unknownword", "vector").total == 0


def test_stream_of_changes(spark, tmp_path):
    source, log_path = tmp_path / "in", str(tmp_path / "log")
    schema = "ext_id string, seq int, deleted boolean, url string, title string, body string, tags string"
    spark.createDataFrame([("a", 1, False, "", "", "one", ""), ("b", 2, False, "", "", "two", "")], schema).write.parquet(str(source / "p1"))
    spark.createDataFrame([("a", 3, True, "", "", "", ""), ("b", 4, False, "", "", "three", "")], schema).write.parquet(str(source / "p2"))
    seen = []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    ingest.append_changes(stream, log_path, str(tmp_path / "ck"), lambda batch, n: seen.append(n)).awaitTermination(120)
    got = ingest.current(spark.read.parquet(log_path).drop("batch")).collect()
    assert [(r.ext_id, r.body) for r in got] == [("b", "three")] and seen


def test_http_rpc_and_command_line(spark, engine, tmp_path):
    from seekframe import serve

    service = serve.Service(engine, fetch=lambda url: (200, "<title>Fetched page</title><p>Some longer prose about llamas and alpacas.</p>"))
    server = serve.http_server(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read() or b"{}")
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        status, found = call("GET", "/api/search?q=shuffle&mode=bm25&topK=zz")
        assert status == 200 and found["total"] == 2
        assert call("GET", "/api/search?q=")[0] == 400 and call("GET", "/api/doc?id=nope")[0] == 404 and call("GET", "/api/doc?id=a")[1]["title"] == "Spark shuffles"
        assert call("POST", "/api/index", b"{bad")[0] == 400 and call("POST", "/api/index", b"{}")[0] == 400
        assert call("POST", "/api/index", b'{"id":"n","body":"narwhal"}')[0] == 200 and call("GET", "/api/search?q=narwhal")[1]["total"] == 1
        assert call("DELETE", "/api/index?id=n")[1] == {"deleted": True} and call("GET", "/api/search?q=narwhal")[1]["total"] == 0
        assert call("POST", "/api/crawl", b'{"url":"http://127.0.0.1/"}')[0] == 422 and call("POST", "/api/crawl", b'{"url":"http://e.example.com/p"}')[1]["ok"]
    finally:
        server.shutdown()
    ask = lambda **m: serve.rpc(service, json.dumps({"jsonrpc": "2.0", **m}))
    assert ask(id=1, method="initialize")["result"]["serverInfo"] and ask(method="note") is None
    assert {t["name"] for t in ask(id=2, method="tools/list")["result"]["tools"]} == {"search", "index_text", "stats", "index_url"}
    assert "llamas" in ask(id=3, method="tools/call", params={"name": "search", "arguments": {"query": "llamas"}})["result"]["content"][0]["text"]
    assert ask(id=4, method="nope")["error"]["code"] == -32601 and serve.rpc(service, "{")["error"]["code"] == -32700
    assert serve.rpc(service, "[" * 100_000)["error"]["code"] == -32700

    (tmp_path / "c.jsonl").write_text('{"id":"1","title":"Otters","body":"otters swim"}\n')
    out = io.StringIO()
    assert serve.main(["search", "otters", "--corpus", str(tmp_path), "--mode", "bm25", "--store", str(tmp_path / "s")], spark, out) == 0 and '"id": "1"' in out.getvalue()
    out = io.StringIO()
    assert serve.main(["dump", "--store", str(tmp_path / "s")], spark, out) == 0 and json.loads(out.getvalue())["title"] == "Otters"
    assert serve.main(["stats", "--corpus", str(tmp_path / "none")], spark, io.StringIO()) == 2 if (tmp_path / "none").mkdir() is None else False
    out = io.StringIO()
    assert serve.main(["analyze", "Two", "words"], spark, out) == 0 and out.getvalue() == "two words\n"
