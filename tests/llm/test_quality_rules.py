"""Lines that many documents of a host share, against counts of documents by hand."""

import random
from collections import Counter, defaultdict

from seekframe.llm import quality_rules

from .test_operators import odd_rows, table, words


def fresh(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def normal(line):
    return " ".join(words(line)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))


def verdicts(rows):
    """(id, text, host) -> kept, without regard to the base rules, by counting documents."""
    own = [(h, Counter()) for _, _, h in rows]
    for (_, t, _), (_, lines) in zip(rows, own):
        for line in (t or "").split("\n"):
            if words(line):
                lines[normal(line)] += len(words(line))
    contents = {(h or "", frozenset(lines)) for h, lines in own if lines}
    size, seen = Counter(h for h, _ in contents), defaultdict(int)
    for h, lines in contents:
        for line in lines:
            seen[h, line] += 1
    out = []
    for (_, t, h), (_, lines) in zip(rows, own):
        n = len(words(t))
        lost = sum(k for line, k in lines.items() if seen[h or "", line] > 20 and seen[h or "", line] > 0.02 * size[h or ""])
        out.append(n - lost >= 0.4 * n)
    return out


def cases():
    rng = random.Random(6)
    nav, foot = "home about contact " + fresh(rng, 60), fresh(rng, 57)
    rows = [(i, f"{nav}\n{fresh(rng, 12)}\n{foot}", "h") for i in range(100)] + [(200 + i, fresh(rng, 80), "h") for i in range(200)]
    copy = fresh(rng, 70) + "\n" + fresh(rng, 30)
    rows += [(500 + i, copy, "h") for i in range(80)]
    banner = [fresh(rng, 20) for _ in range(3)]  # a block of three lines on short pages
    rows += [(600 + i, "\n".join([banner[0], fresh(rng, 15), *banner[1:]]), "g") for i in range(300)]
    rows += [(1000 + i, fresh(rng, 70) + f"\nall rights reserved {i}", "k") for i in range(50)]
    return rows


def test_boilerplate_is_counted_by_documents_and_copies_once(spark):
    rows = cases()
    kept = {r.doc_id: r.kept for r in quality_rules.op7(table(spark, rows)).collect()}
    assert not any(kept[i] for i in range(100)) and all(kept[200 + i] for i in range(200)) and all(kept[500 + i] for i in range(80))
    assert not any(kept[600 + i] for i in range(300)) and all(kept[1000 + i] for i in range(50))
    for (i, t, _), want in zip(rows, verdicts(rows)):
        assert kept[i] == (want and len(words(t)) >= 50)


def test_lines_too_many_to_broadcast(spark):
    rows = [(i, t, s) for i, t, s in cases() + odd_rows() if i is not None]
    docs = table(spark, rows)
    want = sorted((r.id, r.words_left, r.kept) for r in quality_rules.judged(docs).collect())
    assert sorted((r.id, r.words_left, r.kept) for r in quality_rules.judged(docs, broadcast_rows=0).collect()) == want
