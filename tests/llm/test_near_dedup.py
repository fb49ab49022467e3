"""The steps of the near-duplicate search."""

import random

import numpy as np

from seekframe.llm import near_dedup


def test_trees_follow_from_the_chance_to_miss():
    firsts = near_dedup.ORDERS[:, 0]
    assert len(set(firsts.tolist())) == near_dedup.TREES and (1 - 0.8 * 0.9375) ** near_dedup.TREES <= near_dedup.MISSES
    chance = 1.0
    for _ in range(near_dedup.DEPTH):
        chance = 1 - (1 - 0.8 * chance) ** near_dedup.BRANCHES
    assert chance >= 0.9375
    assert 1 + near_dedup.BRANCHES * (near_dedup.DEPTH - 1) <= near_dedup.TOKENS


def test_links_between_lists_span_all_links():
    rng = random.Random(3)
    sets = []
    for g in range(12):
        base = rng.sample(range(g * 1000, g * 1000 + 400), 60)
        for _ in range(8):
            own = set(base)
            for x in rng.sample(base, rng.choice([0, 3, 9])):
                own.discard(x)
                own.add(rng.randrange(10**6, 10**7))
            sets.append(np.array(sorted(own), np.uint64))
    keys = np.arange(100, 100 + len(sets))
    labels = {int(k): int(k) if k % 3 else int(k) - k % 2 for k in keys}
    up = {k: k for k in labels} | {k: v for k, v in labels.items() if v in labels}

    def grouped(links):
        parent = {k: labels[k] if labels[k] in labels else k for k in labels}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return {k: root(k) for k in labels}

    every = [(int(keys[i]), int(keys[j])) for i in range(len(sets)) for j in range(i) if 5 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
    found = near_dedup.links_between(sets, keys, sets, keys, up, 80)
    assert set(found) <= {x for a, b in every for x in ((a, b), (b, a))} and grouped(found) == grouped(every)
    assert len(found) < len(sets)


def test_families_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, i, 0, " ".join([f"m{i}", *base[1:]])) for i in range(40)]  # one large label
    rows += [(0, 100 + i, 100 + i, " ".join(base[:70] + [f"o{i}x{j}" for j in range(30)])) for i in range(20)]
    rows += [(0, 200 + i, 200 + i, " ".join(base[:70] + [f"o{i}x{j}" for j in range(28)] + ["p", "q"])) for i in range(0, 20, 2)]
    rows += [(7, 300, 300, "one family of one label"), (7, 301, 300, "one family of one label too")]
    got = near_dedup.joined_families(spark.createDataFrame(rows, "family long, key long, label long, t string"), 4, 80).collect()
    assert {tuple(sorted(x)) for x in got} == {(100 + i, 200 + i) for i in range(0, 20, 2)}
