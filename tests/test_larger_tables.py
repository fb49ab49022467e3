"""What shows on larger tables only: rows that repeat, and steps that must not grow faster than their input."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekframe.functions import analysis, web
from seekframe.operators import thesaurus
from seekframe.queries import QUERIES


def test_robots_of_a_url_that_comes_more_than_once(spark):
    files = spark.createDataFrame([("h.example.com", "User-agent: *\nDisallow: /p\nAllow: /p/ok\n")], "host string, robots_txt string")
    urls = ["http://h.example.com/p/x", "http://h.example.com/p/ok", "http://h.example.com/p/x", "http://g.example.com/p", "http://g.example.com/p", None, None]
    got = web.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), web.robots_rules(files, "seekframe"))
    assert sorted((r.url or "", r.allowed) for r in got.collect()) == sorted((u or "", u != urls[0]) for u in urls)


def nodes(plan):
    """All nodes of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    children = [plan.children().apply(i) for i in range(plan.children().size())] if inner is None else [inner]
    return [plan] + [x for child in children for x in nodes(child)]


def most_rows(df):
    """Rows of a result, and the most rows that a node of its plan has put out."""
    found = df.collect()
    metric = lambda x: x.metrics().get("numOutputRows")
    return found, max(metric(x).get().value() for x in nodes(df._jdf.queryExecution().executedPlan()) if metric(x).isDefined())


def test_pairs_of_terms_are_counted_without_a_row_for_each(spark):
    rng, words = random.Random(4), [f"w{i}" for i in range(400)]
    docs = [(i, rng.sample(words, 60)) for i in range(40)]
    df = Counter(t for _, terms in docs for t in terms)
    kept = [sorted(sorted((t for t in terms if 2 <= df[t] <= 10), key=lambda t: (df[t], t))[:60]) for _, terms in docs]
    co = Counter(pair for terms in kept for pair in combinations(terms, 2))
    want = {(a, b): (n, round(n / (df[a] * df[b]) ** 0.5, 6)) for (a, b), n in co.items() if n >= 2}
    found, most = most_rows(thesaurus.related_pairs(spark.createDataFrame(docs, "doc_id long, terms array<string>"), 2, 0.5))
    assert {(r.a, r.b): (r.co, r.cosine) for r in found} == {k: v for k, v in want.items() if v[1] >= 0.5}
    assert most <= sum(df.values()) < sum(co.values()) / 10


@pytest.mark.parametrize("gathered", [1, 7, 1 << 20])
def test_pairs_of_a_term_in_several_batches(gathered):
    rng, df = random.Random(5), lambda place: 2 + place // 3
    x = lambda place: df(place) << 32 | place
    rows = sorted((rng.randrange(12), sorted(rng.sample(range(12, 70_020), 3) + rng.sample(range(12, 20), 4))) for _ in range(60))
    batches = [pa.record_batch({"a": pa.array([x(a) for a, _ in rows[i : i + 4]], pa.int64()), "b": pa.array([[x(b) for b in bs] for _, bs in rows[i : i + 4]], pa.list_(pa.int64()))}) for i in range(0, 60, 4)]
    got = pa.Table.from_batches(thesaurus.pair_counts(2, 0.5, gathered)(iter(batches))).to_pylist()
    co = Counter((a, b) for a, bs in rows for b in bs)
    assert {(r["a"], r["b"]): r["co"] for r in got} == {(a, b): n for (a, b), n in co.items() if n >= 2 and n >= 0.499999 * (df(a) * df(b)) ** 0.5}
    assert len(got) == len({(r["a"], r["b"]) for r in got}) > 20
    assert pa.Table.from_batches(thesaurus.pair_counts(2, 0.5)(iter([]))).num_rows == 0


def test_best_terms_are_found_without_a_row_for_each_pair(spark):
    rng, words = random.Random(6), [f"w{i}" for i in range(400)]
    docs = [(i, rng.sample(words, 60)) for i in range(40)]
    pairs = thesaurus.related_pairs(spark.createDataFrame(docs, "doc_id long, terms array<string>"), 2, 0.5)
    both = [x for r in pairs.collect() for x in ((r.a, r.b, r.cosine), (r.b, r.a, r.cosine))]
    want = {(t, i, u, c) for t in {x[0] for x in both} for i, (_, u, c) in enumerate(sorted((x for x in both if x[0] == t), key=lambda x: (-x[2], x[1]))[:8])}
    found, most = most_rows(thesaurus.related_terms(pairs))
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert most <= max(sum(len(terms) for _, terms in docs), len(both))


def test_best_terms_of_copies_are_found_without_a_row_for_each_pair(spark, tmp_path):
    rng, letters = random.Random(8), "abcdefgh"
    words = ["".join(rng.choices(letters, k=7)) for _ in range(2400)]
    texts = [words[i : i + 60] + rng.sample(words, 5) for i in range(0, 2400, 60)]
    rows = [(i, " ".join(texts[i % 40])) for i in range(80)] + [(i, "x") for i in range(80, 90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = Counter(t for _, text in rows for t in set(text.split()))
    kept = [sorted((t for t in set(text.split()) if 2 <= df[t] <= 22), key=lambda t: (df[t], t))[:60] for _, text in rows]
    co = Counter(pair for terms in kept for pair in combinations(sorted(terms), 2))
    both = {}
    for (a, b), n in co.items():
        for x, y in ((a, b), (b, a)):
            both.setdefault(x, []).append((-round(n / (df[a] * df[b]) ** 0.5, 6), y))
    found, most = most_rows(QUERIES["thesaurus_topk"](spark, str(tmp_path)))
    assert {tuple(r) for r in found} == {(t, i, u, -c) for t, xs in both.items() for i, (c, u) in enumerate(sorted(xs)[:8])}
    assert most <= 8 * len(df) < len(co) / 3


@pytest.mark.parametrize("gathered", [1, 50, 1 << 20])
def test_best_pairs_of_packed_terms(gathered):
    rng, df = random.Random(9), lambda place: 36 if place < 10 else 64 if place < 20 else 100  # 3 of 36, 4 of 64 and 5 of 100 are tied
    x = lambda place: df(place) << 32 | place
    docs = [(sorted(rng.sample(range(30), rng.randint(1, 9)) + rng.sample(range(70_000, 70_400), 2)), rng.choice([1, 1, 1, 2, 3])) for _ in range(80)]
    one = pa.record_batch({"t": pa.array([[x(p) for p in t] for t, _ in docs] + [[]], pa.list_(pa.int64())), "n": pa.array([n for _, n in docs] + [1], pa.int64())})
    sent = [r for batch in thesaurus.packed(iter([one.slice(0, 30), one.slice(30), one.slice(0, 0)])) for r in batch.to_pylist()]
    assert [r["t"] for r in sent] == one.column("t").to_pylist()
    rows = sorted(((a, r["p"]) for r in sent for a in r["t"]), key=lambda r: r[0])
    batches = [pa.record_batch({"a": pa.array([a for a, _ in part], pa.int64()), "p": pa.array([p for _, p in part], pa.binary())}) for part in (rows[i : i + 70] for i in range(0, len(rows), 70))]
    got = pa.Table.from_batches(thesaurus.pair_counts(2, 0.08, gathered, 3)(thesaurus.unpacked(iter(batches), 16))).to_pylist()
    co = Counter()
    for t, n in docs:
        co.update({(a, b): n for a in t for b in t if a != b})
    cosine = lambda a, b: round(co[a, b] / (df(a) * df(b)) ** 0.5, 6)
    assert all(r["co"] == co[r["a"], r["b"]] for r in got) and len(got) == len({(r["a"], r["b"]) for r in got})
    for seed in range(3):  # with any order of terms inside a df, and any of the dfs
        name = {p: (random.Random(f"{seed} {df(p)}").random(), p) for p in [*range(30), *range(70_000, 70_400)]}
        best = lambda pairs: {a: sorted((b for x, b in pairs if x == a), key=lambda b: (-cosine(a, b), name[b]))[:3] for a in {a for a, _ in pairs}}
        assert best({(r["a"], r["b"]) for r in got}) == best({p for p, n in co.items() if n >= 2 and cosine(*p) >= 0.08})


@pytest.mark.parametrize("name", ["pooled_vector", "thesaurus_pairs", "thesaurus_topk"])
def test_texts_are_cut_into_terms_once(spark, tmp_path, name):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"{x}{y}" for x in "abcdefgh" for y in "ijklmnop"], k=rng.randint(0, 9))), "en", "a") for i in range(50)]
    spark.createDataFrame([*rows, (50, None, "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    found = df.collect()
    assert len(found) == sum(bool(r[1]) for r in rows) if name == "pooled_vector" else found
    assert sum("regexp_extract_all" in x.expressions().mkString(",") for x in nodes(df._jdf.queryExecution().executedPlan())) == 1


def test_counts_by_term(spark):
    texts = ["b a b", "", None, "x", "a a a a b", "z 1,5 z 10 9 z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", F.inline(analysis.counts_by_term(analysis.latin_terms(F.coalesce("text", F.lit(""))))))
    assert {(r.id, r.term, r.tf) for r in rows.collect()} == {(i, t, n) for i, text in enumerate(texts) for t, n in Counter((text or "").split()).items()}
