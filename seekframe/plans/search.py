"""The engine: builds index tables from documents and answers queries in four modes."""

from __future__ import annotations

import dataclasses
import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.analysis import Lexicon, query_terms, term_arrays, tokens
from ..operators import bm25, fusion, mining, thesaurus, vectors
from ..operators import index as ix
from ..options import EngineOptions
from ..sources import jsonl, store

MODES = ("bm25", "semantic", "vector", "hybrid")
TABLES = ("docs", "postings", "lengths", "field_stats", "related", "lexicon", "vectors", "word_vectors", "center", "graph")


def vector_text() -> Column:
    return F.concat_ws("。", "title", "title", "tags", "body")


def mode_of(name: str | None, default: str = "hybrid") -> str:
    return name.lower() if name and name.lower() in MODES else default


@dataclass
class Result:
    hits: DataFrame
    total: int
    took_ms: float
    mode: str
    tokens: list[str]


#: Stored documents that a change may replace or delete without a build.
CHANGED = 10_000
DOCUMENT = ("ext_id", "url", "title", "body", "tags")


def cleaned(docs: DataFrame) -> DataFrame:
    """DOCUMENT of docs, one row an id: the last by its column `seq`, or, without one, in the table's order."""
    seq = F.col("seq") if "seq" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(F.col("ext_id").cast("string").alias("ext_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DOCUMENT[1:]], seq.alias("seq"))
    return ix.latest(rows, "ext_id", "seq").drop("seq")


class Engine:
    """Tables of one immutable index version. Upserts, deletes and refreshes give a new engine; the old one stays valid.

    An upsert or delete lays its rows over the stored tables and leaves the thesaurus and the word vectors as they are;
    after `layers` changes, and by refresh, the index is built anew.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], lexicon: Lexicon, options: EngineOptions, mined: int = 0, encoder=None, seconds: dict | None = None, depth: int = 0) -> None:
        self.spark, self.tables, self.lexicon, self.options, self.mined, self.encoder, self.seconds, self.depth = spark, tables, lexicon, options, mined, encoder, seconds or {}, depth

    # ------------------------------------------------------------------ building

    @staticmethod
    def build(docs: DataFrame, options: EngineOptions = EngineOptions(), words=(), encoder=None) -> "Engine":
        """docs: (ext_id, url, title, body, tags). words: a dictionary. encoder: a Column function text -> vector, such as a
        TextEncoder; its `query`, if it has one, encodes queries."""
        spark, seconds, began = docs.sparkSession, {}, time.time()
        lexicon, mined = Lexicon(words), 0
        rows = ix.compacted(cleaned(docs), "ext_id").withColumnRenamed("new_id", "doc_id").cache()
        if options.mining:
            # the lexicon's size bound is mining's own: it lives on every worker
            found = mining.mine_words(rows.select(F.concat_ws("。", "title", "body", "tags").alias("text"))).collect()
            for r in found:
                mined += r["term"] not in lexicon
                lexicon.add(r["term"], r["freq"])
        seconds["mining"], at = time.time() - began, time.time()
        tables = Engine._indexed(rows, lexicon if len(lexicon) else None, options)
        seconds["index"], at = time.time() - at, time.time()
        tables["lexicon"] = spark.createDataFrame([(w, f) for w, f in lexicon.freq.items()], "word string, freq long")
        engine = Engine(spark, tables, lexicon, options, mined, encoder, seconds)
        engine._vectors()
        seconds["vectors"] = time.time() - at
        return engine

    @staticmethod
    def _indexed(rows: DataFrame, lexicon: Lexicon | None, options: EngineOptions) -> dict[str, DataFrame]:
        spread = ix.by_field(rows)
        posts = ix.postings(spread, lexicon, stopwords=options.stopwords).cache()
        lens = ix.lengths(spread, lexicon).cache()
        all_docs = term_arrays(rows.select("doc_id", F.concat_ws(" ", "title", "body", "tags").alias("t")), "t", ["doc_id"], lexicon, options.stopwords)
        related = thesaurus.best_terms(all_docs, **options.thesaurus)
        return {"docs": rows, "postings": posts, "lengths": lens, "field_stats": ix.field_stats(lens), "related": related.cache()}

    def _vectors(self) -> None:
        """A given encoder encodes the documents; else word vectors are trained, if there is text enough or it is forced."""
        rows, options = self.tables["docs"], self.options
        if self.encoder is None:
            body = self.tables["field_stats"].filter("field = 'body'").first()
            if not (options.force_vectors or (body and body["total_tokens"] >= options.vector_tokens)):
                return
            sentences = term_arrays(rows.select("doc_id", vector_text().alias("t")), "t", ["doc_id"], self.lexicon if len(self.lexicon) else None).select("terms")
            self.tables["word_vectors"] = vectors.train_word_vectors(sentences, options.dimension).cache()
            self.tables["center"] = vectors.center(self._pooled(rows, self.tables["postings"], rows.count())).cache()
        self.tables["vectors"] = self._encoded(rows, self.tables["postings"], rows.count()).cache()
        if options.knn == "graph" or (options.knn == "auto" and self.tables["vectors"].count() >= options.graph_from):
            first = self.tables["vectors"].first()
            if first is not None:
                self.tables["graph"] = vectors.GraphIndex.build(self.tables["vectors"], len(first["embedding"])).table

    def _pooled(self, rows: DataFrame, posts: DataFrame, n: int) -> DataFrame:
        """(doc_id, embedding): weighted sums of the word vectors of documents."""
        found = tokens(rows.select("doc_id", vector_text().alias("t")), "t", ["doc_id"], self.lexicon if len(self.lexicon) else None)
        tf = found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).join(ix.max_field_freq(posts).select("term", F.col("max_df").alias("df")), "term")
        raw = vectors.pooled(tf, self.tables["word_vectors"], n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))
        return raw.select("doc_id", F.transform("x", lambda x: x["value"]).alias("embedding"))

    def _encoded(self, rows: DataFrame, posts: DataFrame, n: int) -> DataFrame:
        """(doc_id, embedding): unit vectors of documents."""
        if self.encoder is not None:
            return rows.select("doc_id", self.encoder(vector_text()).alias("v")).select("doc_id", vectors.normalized(F.col("v")).alias("embedding"))
        mean = F.broadcast(self.tables["center"].groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("m")))  # one row
        return self._pooled(rows, posts, n).join(mean).select("doc_id", vectors.normalized(F.zip_with("embedding", "m", lambda a, b: a - b["mean"])).alias("embedding"))

    # ------------------------------------------------------------------ changes

    def upsert(self, docs: DataFrame) -> "Engine":
        """A new engine with these documents added or replaced, under the same dictionary; refresh() mines anew."""
        new = cleaned(docs)
        if self.depth >= self.options.layers:
            old = self.tables["docs"].select(*DOCUMENT).join(new.select("ext_id"), "ext_id", "left_anti")
            return self._rebuilt(old.unionByName(new))
        last = self.tables["docs"].agg(F.max("doc_id")).first()[0]
        new = ix.compacted(new, "ext_id").withColumn("doc_id", F.col("new_id") + F.lit(-1 if last is None else last) + 1).select("doc_id", *DOCUMENT).cache()
        return self._changed(new.select("ext_id"), new)

    def delete(self, ids) -> "Engine":
        ids = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "ext_id string")
        if self.depth >= self.options.layers:
            return self._rebuilt(ix.without(self.tables["docs"].select(*DOCUMENT), ids, "ext_id"))
        return self._changed(ids.select(F.col("ext_id").cast("string").alias("ext_id")), None)

    def _changed(self, ids: DataFrame, new: DataFrame | None) -> "Engine":
        """The tables without the documents of ids and with the new ones: no stored row is made again."""
        tables, lexicon = dict(self.tables), self.lexicon if len(self.lexicon) else None
        rows = self.tables["docs"].join(ids, "ext_id", "left_semi").select("doc_id").limit(CHANGED + 1).collect()
        if len(rows) > CHANGED:  # no small change: the index is built anew
            left = ix.without(self.tables["docs"].select(*DOCUMENT), ids, "ext_id")
            return self._rebuilt(left if new is None else left.unionByName(new.select(*DOCUMENT)))
        # as a table of its own it doesn't carry the plans of those it was read from
        gone = self.spark.createDataFrame([(r["doc_id"],) for r in rows], self.tables["docs"].select("doc_id").schema)
        left = lambda name: ix.without(self.tables[name], gone)
        parts: dict[str, DataFrame] = {}
        if new is not None:
            spread = ix.by_field(new)
            parts = {"docs": new, "postings": ix.postings(spread, lexicon, stopwords=self.options.stopwords), "lengths": ix.lengths(spread, lexicon)}
        for name in ("docs", "postings", "lengths"):
            tables[name] = left(name).unionByName(parts[name].select(*self.tables[name].columns)) if name in parts else left(name)
        tables["field_stats"] = ix.field_stats(tables["lengths"])
        tables.pop("graph", None)  # exact search until the next build
        if "vectors" in tables:
            tables["vectors"] = left("vectors")
            if new is not None:
                own = tables["postings"].join(parts["postings"].select("term").distinct(), "term", "left_semi")
                tables["vectors"] = tables["vectors"].unionByName(self._encoded(new, own, tables["docs"].count()))
        return Engine(self.spark, tables, self.lexicon, self.options, self.mined, self.encoder, self.seconds, self.depth + 1)

    def _rebuilt(self, docs: DataFrame) -> "Engine":
        engine = Engine.build(docs, dataclasses.replace(self.options, mining=False), self.lexicon.freq, self.encoder)
        engine.options, engine.mined = self.options, self.mined
        return engine

    def close(self) -> None:
        """Give up the tables held in memory, when no engine made from this one is in use."""
        for table in self.tables.values():
            table.unpersist()

    def refresh(self) -> "Engine":
        return Engine.build(self.tables["docs"].select(*DOCUMENT), dataclasses.replace(self.options, mining=True), self.lexicon.freq, self.encoder)

    def save(self, path: str) -> None:
        marks = jsonl.fingerprint(self.tables["docs"]).first()
        store.save(self.spark, path, {k: v for k, v in self.tables.items() if k in TABLES}, {"n_docs": marks["n_docs"], "checksum": marks["checksum"], "stopwords": self.options.stopwords, "mined": self.mined})

    @staticmethod
    def restore(spark: SparkSession, path: str, options: EngineOptions = EngineOptions(), expected: dict | None = None, encoder=None, verify: bool = True) -> "Engine":
        """The saved tables are used as they are, thesaurus and vectors included. Other stopword settings, another format,
        another checksum than expected or, with verify, tables that are not as saved raise StaleStore."""
        tables, facts = store.load(spark, path, {"stopwords": options.stopwords, **(expected or {})}, verify)
        lexicon = Lexicon()
        for r in tables["lexicon"].collect():
            lexicon.add(r["word"], r["freq"])
        return Engine(spark, tables, lexicon, options, facts["mined"], encoder)

    # ------------------------------------------------------------------ queries

    def lexical_scores(self, terms) -> DataFrame:
        return bm25.scores(self.tables["postings"], self.tables["lengths"], self.tables["field_stats"], terms, self.options)

    def expanded(self, terms: list[str]) -> dict[str, float]:
        found = thesaurus.expansion(self.tables["related"], terms, self.options.expansion).collect()  # a dozen rows
        return {t: 1.0 for t in terms} | {r["term"]: float(r["weight"]) for r in found}

    def vector_scores(self, query: str, terms: list[str]) -> DataFrame | None:
        """None without vectors or without a known word in the query."""
        if "vectors" not in self.tables:
            return None
        if self.encoder is not None:
            v = self.spark.createDataFrame([(query,)], "t string").select(getattr(self.encoder, "query", self.encoder)(F.col("t")).alias("v")).select(vectors.normalized(F.col("v")).alias("v")).first()["v"]
        else:
            n = self.tables["docs"].count()
            tf = self.spark.createDataFrame([(0, t, terms.count(t)) for t in dict.fromkeys(terms)], "doc_id int, term string, tf int")
            df = ix.max_field_freq(self.tables["postings"].filter(F.col("term").isin(terms))).select("term", F.col("max_df").alias("df"))
            raw = vectors.pooled(tf.join(df, "term"), self.tables["word_vectors"], n).join(self.tables["center"], "i").select("i", (F.col("value") - F.col("mean")).alias("x")).orderBy("i").collect()
            norm = sum(r["x"] ** 2 for r in raw) ** 0.5
            if not raw or not norm:
                return None
            v = [r["x"] / norm for r in raw]
        if "graph" in self.tables:
            return vectors.GraphIndex(self.tables["graph"], len(v)).search([(0, v)], self.options.pool, self.options.graph_ef).select("doc_id", "score")
        return vectors.nearest(self.tables["vectors"], v, self.options.pool)

    def ranked(self, query: str, mode: str = "hybrid", pool: int | None = None) -> DataFrame:
        """(doc_id, score, rank from 0 and, where they exist, bm25, semantic, cosine)."""
        terms, pool = query_terms(query, self.lexicon), pool or self.options.pool
        lists: dict[str, DataFrame] = {}
        if mode in ("bm25", "hybrid"):
            lists["bm25"] = bm25.ranked(self.lexical_scores(terms), pool)
        if mode in ("semantic", "hybrid"):
            lists["semantic"] = bm25.ranked(self.lexical_scores(self.expanded(terms)), pool)
        if mode in ("vector", "hybrid") and (found := self.vector_scores(query, terms)) is not None:
            lists["cosine"] = bm25.ranked(found, pool)
        if not lists:
            return self.tables["docs"].select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        if mode == "hybrid":
            top = bm25.ranked(fusion.reciprocal_rank(list(lists.values()), self.options.fusion, self.options.rrf_k), pool, 12)
        else:
            top = next(iter(lists.values()))
        for name, one in lists.items():
            top = top.join(one.select("doc_id", F.col("score").alias(name)), "doc_id", "left")
        return top

    def search(self, query: str, mode: str = "hybrid", top_k: int = 10, offset: int = 0, phrase: bool = False, highlight: bool = True) -> Result:
        began, terms = time.time(), query_terms(query, self.lexicon)
        top = self.ranked(query, mode)
        if phrase and len(terms) > 1:
            top = top.join(ix.phrase(self.tables["postings"], terms).select("doc_id").distinct(), "doc_id", "left_semi")
        found = top.orderBy("rank").collect()  # at most `pool` rows
        total, begin = len(found), max(0, offset)
        names = [c for c in top.columns if c != "rank"]
        page = [(*[r[c] for c in names], begin + i) for i, r in enumerate(found[begin : begin + max(1, min(self.options.pool, top_k))])]
        kinds = ", ".join(f"{c} {top.schema[c].dataType.simpleString()}" for c in names)
        # ids first: the filter reaches the documents' scan
        own = self.tables["docs"].filter(F.col("doc_id").isin([r[names.index("doc_id")] for r in page]))
        rows = own.join(F.broadcast(self.spark.createDataFrame(page, f"{kinds}, rank int")), "doc_id")  # a page of hits
        wanted, lexicon, options = set(terms), self.lexicon, self.options

        @F.pandas_udf("string")
        def show(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: tx.snippet(t, wanted, lexicon, options.snippet_tokens, options.snippet_chars))

        @F.pandas_udf("string")
        def mark(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: tx.marked(t or "", lexicon.analyze(t), wanted))

        score = F.round(1 / (self.options.rrf_k + F.col("rank") + 1.0), 6) if mode == "hybrid" else F.col("score")
        parts = [c for c in ("bm25", "semantic", "cosine") if c in rows.columns]
        explain = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in parts]), F.array(*[F.round(c, 6) for c in parts])), lambda _, v: v.isNotNull()) if parts else F.lit(None).cast("map<string,double>")
        hits = rows.select(
            "rank",
            F.col("ext_id").alias("id"),
            "url",
            (mark("title") if highlight else F.col("title")).alias("title"),
            (show("body") if highlight else tx.plain_excerpt(F.col("body"))).alias("snippet"),
            score.alias("score"),
            F.col("score").alias("fused" if mode == "hybrid" else "own"),
            tx.split_tags(F.col("tags")).alias("tags"),
            explain.alias("contributions"),
        ).orderBy("rank")
        return Result(hits, total, round((time.time() - began) * 1000, 3), mode, terms)

    def document(self, ext_id: str):
        return self.tables["docs"].filter(F.col("ext_id") == ext_id).first()

    def stats(self) -> dict:
        t = self.tables
        marks = jsonl.fingerprint(t["docs"]).first()
        return {
            "documents": marks["n_docs"], "fingerprint": marks["checksum"], "terms": t["postings"].select("term").distinct().count(), "dictionary_words": len(self.lexicon), "mined_words": self.mined,
            "stopwords": self.options.stopwords, "mining": self.options.mining, "bm25": {"k1": self.options.k1, "b": self.options.b}, "rrf_k": self.options.rrf_k,
            "encoder": "given" if self.encoder is not None else "trained" if "word_vectors" in t else "none", "vocabulary": t["word_vectors"].count() if "word_vectors" in t else 0,
            "thesaurus_entries": t["related"].select("term").distinct().count(), "knn": "graph" if "graph" in t else "exact", "vectors": t["vectors"].count() if "vectors" in t else 0, "stage_seconds": self.seconds, "analyzer": "mixed",
        }
