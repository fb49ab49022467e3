"""The mixing stage of the pipeline on rows that repeat an id or have none."""

from collections import Counter

import corpus_pipeline as cp


def test_mix_keeps_rows_of_one_id_apart(spark):
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a", 40), "en", "s"), (1, text("b", 70), "en", "s"), (2, text("c", 50), "en", "s"), (2, text("c", 50), "en", "s")]
    rows += [(None, text(f"n{j}x", 30 + j), "en", "t") for j in range(6)] + [(3, text("d", 60), None, "t"), (3, text("d", 60), "en", "t")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.mix(spark, docs, "").collect()
    placed, pieces = cp.mixing.mix_sources(docs)
    want = Counter()
    for r in pieces.join(placed.select("row", "mix_source"), "row").collect():
        want[r.mix_source] += r.taken
    taken, copies = Counter(), Counter()
    known = Counter((i, x, s) for i, t, _, s in rows for x in t.split())
    for r in got:
        assert r.n_chars == len(r.text)
        for x in r.text.split():
            taken[r.source] += 1
            copies[r.doc_id, x, r.source] += 1
    assert taken == want and sum(taken.values()) > 0
    assert all(n <= 3 * known[k] for k, n in copies.items())
