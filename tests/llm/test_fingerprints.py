import hashlib
import random

import numpy as np

from seekframe.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, key string, part int"


def brute_select(text):
    points = fp.code_points(text)
    hashes = fp.gram_hashes(points).tolist()
    w, at = min(fp.WINDOW, len(hashes)), []
    for i in range(len(hashes) - w + 1 if hashes else 0):
        least = min(hashes[i : i + w])
        j = max(k for k in range(i, i + w) if hashes[k] == least)
        if not at or at[-1] != j:
            at.append(j)
    return [(hashes[j], j) for j in at]


def test_winnow_is_the_rightmost_minimum_of_every_window():
    rng = random.Random(3)
    for n in (0, 1, 5, 23, 24, 25, 63, 64, 300, 1000):
        text = "".join(rng.choice("abé🙂 ") for _ in range(n))
        assert fp.read(fp.written(*fp.select(fp.code_points(text)))) == brute_select(text)
    ties = np.array([5, 1, 1, 1, 7, 1, 9, 9, 9, 9], np.uint32)
    assert fp.winnow(ties, 4).tolist() == [3, 5, 8] or fp.winnow(ties, 4).tolist()[0] == 3


def test_gram_hash_depends_on_the_gram_only():
    a, b = "x" * 7 + "the quick brown fox jumps over", "yy" + "the quick brown fox jumps over"
    ha, hb = fp.gram_hashes(fp.code_points(a)), fp.gram_hashes(fp.code_points(b))
    assert ha[7:].tolist() == hb[2:].tolist()


def test_query_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choice("abcdé🙂 \n") for _ in range(rng.choice([0, 1, 2, 10, 200, 900])))) for i in range(60)]
    rows += [(None, "null id " * 20), (7, None), (8, ""), (9, rows[3][1]), (9, rows[3][1]), (-5, "z" * 5000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA).repartition(5)
    got = fp.op6(df).collect()
    order = sorted(((fp.NULL_ID if i is None else i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        h, e, x = ({y for y, _ in brute_select(z)} for z in (t, edited, nxt))
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(h, e), 9), round(like(h, x), 9)))
    assert sorted((fp.NULL_ID if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_empty_and_single(spark):
    assert fp.op6(spark.createDataFrame([], SCHEMA)).collect() == []
    row = fp.op6(spark.createDataFrame([(1, "abcdef", "k", 1)], SCHEMA)).collect()
    assert len(row) == 1 and row[0].near_next == 1.0 and row[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
