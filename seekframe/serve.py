"""Thin front ends over an Engine: JSON over HTTP, JSON-RPC over standard input, and a command line."""

from __future__ import annotations

import argparse
import json
import re
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import web
from .functions.analysis import Lexicon
from .functions.encoder import TextEncoder
from .operators import vectors
from .options import EngineOptions
from .plans.evaluate import evaluate, report
from .plans.measure import measure
from .plans.search import Engine, mode_of
from .sources import jsonl
from .sources.fetch import Fetcher, Refused
from .sources.synthetic import synthesize

BODY_LIMIT = 8 << 20
AGENT = "seekframe"
DOC = "ext_id string, url string, title string, body string, tags string"


class Service:
    """Holds the current engine; changes replace it, queries keep the one they began with."""

    def __init__(self, engine: Engine, fetch=None) -> None:
        self.engine, self.fetch, self.lock, self.robots = engine, fetch, threading.Lock(), {}

    def search(self, text: str, mode: str | None = None, top_k: int = 10, offset: int = 0, phrase: bool = False, highlight: bool = True) -> dict:
        result = self.engine.search(text, mode_of(mode), top_k, offset, phrase, highlight)
        hits = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in result.hits.collect()]
        return {"query": text, "mode": result.mode, "total": result.total, "tookMs": result.took_ms, "tokens": result.tokens, "hits": hits}

    def index(self, doc: dict, refresh: bool = False) -> dict:
        if not str(doc.get("id", "")).strip():
            raise ValueError("id is required")
        tags = doc.get("tags", "")
        row = tuple(str(doc.get(k, "")) for k in ("id", "url", "title", "body")) + (",".join(map(str, tags)) if isinstance(tags, list) else str(tags),)
        with self.lock:
            engine = self.engine.upsert(self.engine.spark.createDataFrame([row], DOC))
            self.engine = engine.refresh() if refresh else engine
        return {"indexed": row[0], "documents": self.engine.tables["docs"].count()}

    def delete(self, ext_id: str) -> dict:
        found = self.engine.document(ext_id) is not None
        with self.lock:
            self.engine = self.engine.delete([ext_id]) if found else self.engine
        return {"deleted": found}

    def allowed(self, url: str) -> bool:
        """Whether the robots file of the url's host, read once, lets it be fetched."""
        spark, root = self.engine.spark, "/".join(url.split("/", 3)[:3])
        host = root.split("://", 1)[-1]
        if host not in self.robots:
            try:
                status, text = self.fetch(f"{root}/robots.txt")
            except OSError:
                status, text = 0, ""
            self.robots[host] = text if 200 <= status < 300 else ""
        files = spark.createDataFrame([(re.sub(":(80|443)$", "", host.lower()), self.robots[host])], "host string, robots_txt string")
        return web.robots_allowed(spark.createDataFrame([(url,)], "url string"), web.robots_rules(files, AGENT)).first()["allowed"]

    def crawl(self, url: str, allow_private: bool = False) -> dict:
        """Fetch one page by the given fetcher (url -> (status, html)), extract it and index it."""
        spark = self.engine.spark
        facts = spark.createDataFrame([(url,)], "url string").select(web.normalized_url(F.col("url")).alias("n"), web.target_reason(F.col("url")).alias("why")).first()
        if facts["why"] and not allow_private:
            return {"ok": False, "url": url, "reason": facts["why"]}
        try:
            if not self.allowed(facts["n"]):
                return {"ok": False, "url": url, "reason": "blocked by robots.txt"}
            status, html = self.fetch(facts["n"])
        except (Refused, OSError) as e:
            return {"ok": False, "url": url, "reason": str(e)}
        if not 200 <= status < 300:
            return {"ok": False, "url": url, "reason": f"status {status}"}
        page = web.extracted(spark.createDataFrame([(0, facts["n"], html)], "page_id int, url string, html string")).first()
        if not page["title"].strip() and not page["body"].strip():
            return {"ok": False, "url": url, "reason": "no prose"}
        self.index({"id": f"url:{facts['n']}", "url": facts["n"], "title": page["title"], "body": page["body"]})
        return {"ok": True, "url": url, "title": page["title"], "chars": len(page["body"]), "links": page["links"]}


def number(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None else default
    except ValueError:
        return default


def flag(text: str | None) -> bool:
    return text is not None and text.lower() in ("", "1", "true", "on")


def http_server(service: Service, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None: ...

        def answer(self, status: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json; charset=utf-8"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, DELETE, OPTIONS"), ("Content-Length", str(len(data)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def body(self) -> dict:
            found = json.loads(self.rfile.read(number(self.headers.get("Content-Length"), 0)) or b"{}")
            if not isinstance(found, dict):
                raise ValueError("an object is expected")
            return found

        def route(self) -> None:
            parts = urlsplit(self.path)
            q, at = dict(parse_qsl(parts.query, keep_blank_values=True)), (self.command, parts.path)
            try:
                if self.command == "OPTIONS":
                    return self.answer(204, {})
                if number(self.headers.get("Content-Length"), 0) > BODY_LIMIT:
                    return self.answer(413, {"error": "body too large"})
                if at == ("GET", "/api/search"):
                    if not q.get("q", "").strip():
                        return self.answer(400, {"error": "q is required"})
                    return self.answer(200, service.search(q["q"].strip(), q.get("mode"), min(200, max(1, number(q.get("topK"), 10))), max(0, number(q.get("from"), 0)), flag(q.get("phrase")), not flag(q.get("noHighlight"))))
                if at == ("GET", "/api/stats"):
                    return self.answer(200, service.engine.stats())
                if at == ("GET", "/api/doc"):
                    doc = service.engine.document(q.get("id", q.get("docId", "")))
                    return self.answer(200, doc.asDict()) if doc else self.answer(404, {"error": "no such document"})
                if at == ("POST", "/api/index"):
                    return self.answer(200, service.index(self.body(), flag(q.get("refresh"))))
                if at == ("DELETE", "/api/index"):
                    return self.answer(200, service.delete(q.get("id", "")))
                if at == ("POST", "/api/crawl"):
                    if service.fetch is None:
                        return self.answer(503, {"error": "crawling is off"})
                    found = service.crawl(str(self.body().get("url", "")))
                    return self.answer(200 if found["ok"] else 422, found)
                return self.answer(404, {"error": "not found"})
            except ValueError as e:  # JSON errors are ValueErrors
                self.answer(400, {"error": f"malformed request: {str(e)[:200]}"})
            except Exception as e:
                self.answer(500, {"error": f"{type(e).__name__}: {str(e)[:200]}"})

        do_GET = do_POST = do_DELETE = do_OPTIONS = route

    return ThreadingHTTPServer((host, port), Handler)


def tools(service: Service) -> list[dict]:
    schema = lambda required, **kinds: {"type": "object", "properties": {k: {"type": v} for k, v in kinds.items()}, "required": required}
    found = [
        {"name": "search", "description": "Search the documents", "inputSchema": schema(["query"], query="string", mode="string", topK="integer", phrase="boolean")},
        {"name": "index_text", "description": "Add or replace a document", "inputSchema": schema(["id"], id="string", title="string", body="string", tags="string")},
        {"name": "stats", "description": "What the engine holds", "inputSchema": schema([])},
    ]
    if service.fetch is not None:
        found.append({"name": "index_url", "description": "Fetch and index a page", "inputSchema": schema(["url"], url="string")})
    return found


def rpc(service: Service, line: str) -> dict | None:
    """One JSON-RPC message in, one out; None for notifications."""
    try:
        message = json.loads(line)
    except (ValueError, RecursionError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if not isinstance(message, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "an object is expected"}}
    method, given = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = lambda **x: {"jsonrpc": "2.0", "id": message["id"], **x}
    try:
        if method == "initialize":
            return reply(result={"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "seekframe", "version": "1"}})
        if method == "ping":
            return reply(result={})
        if method == "tools/list":
            return reply(result={"tools": tools(service)})
        if method == "tools/call":
            name, args = given.get("name"), given.get("arguments") or {}
            if name == "search":
                out = service.search(str(args.get("query", "")), args.get("mode"), min(50, max(1, int(args.get("topK", 10)))), 0, bool(args.get("phrase")), False)
            elif name == "index_text":
                out = service.index(args)
            elif name == "stats":
                out = service.engine.stats()
            elif name == "index_url" and service.fetch is not None:
                out = service.crawl(str(args.get("url", "")))
            else:
                return reply(error={"code": -32601, "message": f"no tool {name}"})
            return reply(result={"content": [{"type": "text", "text": json.dumps(out, ensure_ascii=False, default=str)}], "isError": False})
        return reply(error={"code": -32601, "message": f"no method {method}"})
    except Exception as e:
        return reply(error={"code": -32603, "message": f"{type(e).__name__}: {str(e)[:200]}"})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seekframe")
    p.add_argument("command", choices=("serve", "search", "index", "dump", "delete", "analyze", "vector", "stats", "mcp", "build", "eval", "crawl", "bench", "regold"))
    p.add_argument("text", nargs="*")
    for name in ("corpus", "store", "dict", "out", "id", "mode", "queries", "model"):
        p.add_argument(f"--{name}")
    for name, value in (("port", 8080), ("top", 10), ("from", 0), ("docs", 0), ("repetitions", 3)):
        p.add_argument(f"--{name}", type=int, default=value)
    for name, value in (("k1", 1.2), ("b", 0.75)):
        p.add_argument(f"--{name}", type=float, default=value)
    p.add_argument("--knn", choices=("auto", "exact", "graph"), default="auto")
    for name in ("phrase", "stopwords", "force-vectors", "no-mining", "allow-private", "mean-pooling", "no-instruction"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--fusion", type=lambda s: tuple(map(float, s.split(","))), default=EngineOptions().fusion)
    return p


def regold(path: str, lexicon: Lexicon, out: str | None = None) -> int:
    """Cuts the sentences of a gold file (sentence, tab, terms joined by a blank) anew; comments and blank lines stay."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    cut = [i for i, line in enumerate(lines) if line.strip() and not line.startswith("#")]
    for i in cut:
        sentence = lines[i].split("\t")[0]
        lines[i] = sentence + "\t" + " ".join(t["term"] for t in lexicon.analyze(sentence))
    with open(out or path, "w", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines))
    return len(cut)


def main(argv=None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    say, text = lambda x: print(x, file=out), " ".join(a.text)
    spark = spark or SparkSession.builder.appName("seekframe").getOrCreate()
    words = [r["word"] for r in jsonl_dictionary(spark, a.dict)] if a.dict else []
    if a.command == "analyze":
        say(" ".join(t["term"] for t in Lexicon(words).analyze(text, a.stopwords)))
        return 0
    if a.command == "regold":
        written = regold(text, Lexicon(words), a.out)
        say(f"{written} sentences cut")
        return 0
    options = EngineOptions(k1=a.k1, b=a.b, stopwords=a.stopwords, mining=not a.no_mining, force_vectors=a.force_vectors, fusion=a.fusion, knn=a.knn)
    encoder = TextEncoder(spark, a.model, not a.mean_pooling, instruct=not a.no_instruction) if a.model else None
    if a.corpus:
        docs = jsonl.read_corpus(spark, a.corpus)
        if docs.isEmpty():
            say(f"nothing to read in {a.corpus}")
            return 2
        if a.command == "bench":
            asked = [r["query"] for r in jsonl.read_queries(spark, a.queries).select("query").collect()] if a.queries else [text]
            written = json.dumps(measure(synthesize(docs, a.docs) if a.docs else docs, asked, options, words, encoder=encoder, repetitions=a.repetitions, top_k=a.top))
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(written + "\n")
            else:
                say(written)
            return 0
        engine = Engine.build(docs, options, words, encoder)
    elif a.store:
        engine = Engine.restore(spark, a.store, options, encoder=encoder)
    else:
        say("--corpus or --store is required")
        return 2
    service = Service(engine, Fetcher(allow_private=a.allow_private))
    if a.command == "search":
        for hit in service.search(text, a.mode, a.top, getattr(a, "from"), a.phrase)["hits"]:
            say(json.dumps(hit, ensure_ascii=False))
    elif a.command == "index":
        service.engine = engine.upsert(jsonl.json_lines(jsonl.numbered_lines(spark, text).select("value", "line")))
    elif a.command == "delete":
        say(json.dumps(service.delete(a.id or text)))
    elif a.command == "eval":
        written = report(evaluate(engine, jsonl.read_queries(spark, a.queries or text), min(a.top, 5)), min(a.top, 5))
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(written)
        else:
            say(written)
    elif a.command == "crawl":
        for url in a.text:
            say(json.dumps(service.crawl(url, a.allow_private), ensure_ascii=False))
    elif a.command == "stats":
        say(json.dumps(engine.stats(), ensure_ascii=False, default=str))
    elif a.command == "vector":
        for r in vectors.nearest_words(engine.tables["word_vectors"], text, a.top).collect() if "word_vectors" in engine.tables else ():
            say(f"{r['term']}\t{r['score']}")
    elif a.command == "dump":
        lines = jsonl.to_json_lines(engine.tables["docs"])
        if a.out:
            lines.write.mode("overwrite").text(a.out)
        else:
            for r in lines.toLocalIterator():
                say(r["value"])
    elif a.command == "serve":
        http_server(service, a.port).serve_forever()
    elif a.command == "mcp":
        for line in sys.stdin:
            if (reply := rpc(service, line)) is not None:
                print(json.dumps(reply, ensure_ascii=False), flush=True)
    if a.store and (a.corpus or a.command in ("index", "delete", "build", "crawl")):
        service.engine.save(a.store)
    return 0


def jsonl_dictionary(spark: SparkSession, path: str):
    from .functions.analysis import dictionary_words

    return dictionary_words(spark.read.text(path)).collect()


if __name__ == "__main__":
    sys.exit(main())
