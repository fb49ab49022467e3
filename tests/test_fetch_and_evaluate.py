"""Fetching with judged addresses, the crawl and eval commands, and quality on labelled queries."""

import http.server
import io
import json
import socket
import threading

import pytest

from seekframe import serve
from seekframe.options import EngineOptions
from seekframe.plans.evaluate import evaluate, report
from seekframe.plans.search import Engine
from seekframe.sources.fetch import Fetcher, Refused, address_reason

PAGES = {"/robots.txt": "User-agent: *\nDisallow: /private", "/a": "<title>Alpacas</title><p>Longer prose about alpacas and llamas.</p>", "/private/b": "<title>No</title><p>Prose that may not be read here.</p>"}


@pytest.fixture(scope="module")
def site():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", "http://10.0.0.1/")
                self.end_headers()
                return
            if self.path == "/moved":
                self.send_response(301)
                self.send_header("Location", "/a")
                self.end_headers()
                return
            body = PAGES.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port
    server.shutdown()


def resolver(address):
    return lambda host, port, type=0: [(socket.AF_INET, type, 6, "", (address, port))]


def test_addresses_are_judged_after_they_are_resolved(site):
    assert [address_reason(x) for x in ("127.0.0.1", "::1", "::ffff:10.0.0.1", "64:ff9b::7f00:1", "2002:a00:1::", "fe80::1%eth0", "169.254.1.1", "100.64.0.1", "0.0.0.0", "fd00::1")].count(None) == 0
    assert address_reason("8.8.8.8") is None and address_reason("2606:4700::1111") is None
    assert Fetcher(resolve=resolver("10.1.1.1")).reason("http://public.example.com/") == "private network target"
    assert Fetcher(resolve=resolver("8.8.8.8")).reason("http://public.example.com/") is None
    with pytest.raises(Refused, match="loopback"):
        Fetcher()(f"http://127.0.0.1:{site}/a")
    # a name that is resolved to one address and connected at another
    with pytest.raises(Refused, match="loopback"):
        Fetcher(resolve=resolver("8.8.8.8"))(f"http://localhost:{site}/a")


def test_pages_redirects_and_limits(site):
    fetch = Fetcher(allow_private=True)
    assert fetch(f"http://127.0.0.1:{site}/moved") == (200, PAGES["/a"]) and fetch(f"http://127.0.0.1:{site}/none")[0] == 404
    assert Fetcher(allow_private=True, limit=5)(f"http://127.0.0.1:{site}/a") == (200, "<titl")

    class Guarded(Fetcher):
        def reason(self, url):
            return "private network target" if "10.0.0.1" in url else None

    with pytest.raises(Refused, match="private"):
        Guarded(allow_private=True)(f"http://127.0.0.1:{site}/away")


QUERIES = [("q1", "alpha", ["1"], "lexical"), ("q2", "beta gamma", ["2", "3"], "lexical"), ("q3", "delta", ["9"], "semantic"), ("q4", "alpha", [], "semantic")]


def test_quality_of_an_engine(spark):
    rows = [("1", "", "alpha", "alpha one", ""), ("2", "", "", "beta gamma", ""), ("3", "", "", "gamma", ""), ("4", "", "", "delta", "")]
    engine = Engine.build(spark.createDataFrame(rows, "ext_id string, url string, title string, body string, tags string"), EngineOptions(mining=False))
    got = {(r.mode, r.kind): r for r in evaluate(engine, spark.createDataFrame(QUERIES, "query_id string, query string, relevant array<string>, kind string"), 5, ("bm25", "hybrid")).collect()}
    assert got["bm25", "lexical"].recall == 1 and got["bm25", "lexical"].mrr == 1 and got["bm25", "lexical"].n == 2
    assert got["bm25", "semantic"].n == 1 and got["bm25", "semantic"].hit_rate == 0 and got["hybrid", "all"].n == 3
    text = report(evaluate(engine, spark.createDataFrame(QUERIES, "query_id string, query string, relevant array<string>, kind string"), 5, ("bm25",)), 5)
    assert "| lexical | bm25 | 2 | 1.000 |" in text


def test_commands(spark, site, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","title":"Otters","body":"otters swim"}\n')
    (tmp_path / "q.txt").write_text('{"id":"q","query":"otters","relevant":["1"]}\n')
    out = io.StringIO()
    assert serve.main(["eval", "--corpus", str(tmp_path), "--queries", str(tmp_path / "q.txt"), "--no-mining"], spark, out) == 0 and "| all | bm25 | 1 | 1.000 |" in out.getvalue()
    out, root = io.StringIO(), f"http://127.0.0.1:{site}"
    assert serve.main(["crawl", f"{root}/a", f"{root}/private/b", "--corpus", str(tmp_path), "--allow-private", "--no-mining"], spark, out) == 0
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["ok"] and first["title"] == "Alpacas" and second["reason"] == "blocked by robots.txt"
    out = io.StringIO()
    serve.main(["crawl", f"{root}/a", "--corpus", str(tmp_path), "--no-mining"], spark, out)
    assert json.loads(out.getvalue())["reason"] == "loopback target"
