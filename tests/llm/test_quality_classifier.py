"""Posteriors against the formulas by hand, and odd rows."""

import math
import random
from collections import defaultdict

import numpy as np

from seekframe.llm import quality_classifier as qc

from .test_operators import WORDS, odd_rows, table


def by_hand(rows):
    """(evidence, host, path) -> (host posterior, path posterior, own prior, score) of each row."""
    n, total = len(rows), sum(e for e, _, _ in rows)
    prior, groups = total / n, (defaultdict(list), defaultdict(list))
    for e, h, p in rows:
        groups[0][h].append(e)
        groups[1][h, p].append(e)

    def strength(level, parent):
        sizes = {g: len(x) for g, x in level.items()}
        within = sum(sizes[g] * parent(g) * (1 - parent(g)) for g in level) / n
        between = sum(sizes[g] * (sum(x) / len(x) - parent(g)) ** 2 for g, x in level.items())
        k = len(level)
        if not within or k < 2 or n <= k:
            return qc.MOST_STRENGTH
        r = (between / within - k) / (n - k)
        return min(qc.MOST_STRENGTH, max(qc.LEAST_STRENGTH, 1 / r - 1)) if r > 0 else qc.MOST_STRENGTH

    sh = strength(groups[0], lambda g: prior)
    host = {h: (sh * prior + sum(x)) / (sh + len(x)) for h, x in groups[0].items()}
    sp = strength(groups[1], lambda g: host[g[0]])
    path = {g: (sp * host[g[0]] + sum(x)) / (sp + len(x)) for g, x in groups[1].items()}
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    out = []
    for e, h, p in rows:
        others = (total - e) / (n - 1) if n > 1 else 0.5
        up = (sh * others + sum(groups[0][h]) - e) / (sh + len(groups[0][h]) - 1)
        own = (sp * up + sum(groups[1][h, p]) - e) / (sp + len(groups[1][h, p]) - 1)
        out.append((host[h], path[h, p], own, 1 / (1 + math.exp(-(logit(e) + logit(own) - logit(others))))))
    return out


def test_posteriors_against_the_formulas(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(WORDS) + "%%%" * rng.choice([0, 1]) for _ in range(80))
    rows = [(i, good() if rng.random() < 0.2 + 0.15 * (i % 5) else bad(), f"h{i % 5}") for i in range(500)] + [(900, bad(), "h0"), (901, good(), None), (902, bad(), "lone"), (902, bad(), "lone")]
    labels = spark.createDataFrame([(i, int("%" not in rows[i][1]), 0) for i in range(0, 500, 3)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = qc.classified(docs, labels).toPandas()
    host = {i: s or "" for i, _, s in rows}
    got = got.sort_values(["id", "evidence"])
    want = by_hand([(e, host[i], "en") for e, i in zip(got.evidence, got.id)])
    assert len(got) == len(rows) and np.allclose(got[["host_posterior", "path_posterior", "prior", "score"]].to_numpy(), np.array(want), atol=1e-9)
    assert (got.kept == (got.score >= 0.5)).all()


def test_odd_rows_and_many_rows_of_one_labelled_id(spark, monkeypatch):
    rows = odd_rows() + [(7, f"text number {i} of one id " + "w " * i, "s1") for i in range(300)] + [(7, "one copy", "s1")] * 50
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (3, 0, 0), (100, 0, 0), (101, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(qc, "SAMPLE_ROWS", 20)
    seen = []
    fit = qc.fit
    monkeypatch.setattr(qc, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    got = qc.classified(table(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and 5 <= seen[0] <= 45
    assert len(set(got[got.id.isin([104, 3])].evidence.round(12))) == 1
