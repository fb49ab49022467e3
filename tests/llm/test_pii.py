"""Personal data: terms of rare entities, sanitised rows, many matches."""

import math
import random
import re
import time
from collections import Counter, defaultdict

from seekframe.llm import pii

from .test_operators import odd_rows, table, valid


def disclosing_terms(texts):
    """(row, term) of every marked term, by counting documents by hand."""
    value = {k: re.compile({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+){3}", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}[k]) for k in pii.KINDS}
    group = {"email": lambda v: "@" + v.split("@")[1], "ip": lambda v: ".".join(v.split(".")[:2]) + ".*", "card": lambda v: re.sub("[^0-9]", "", v)[:6] + "*", "phone": lambda v: "+" + re.sub("[^0-9]", "", v)[:4] + "*"}
    near, of_kind, with_entity, with_term, n = defaultdict(set), defaultdict(set), defaultdict(set), Counter(), len(texts)
    for i, t in enumerate(texts):
        spans = [(k, m.start(), m.end(), m[0].lower()) for k in pii.KINDS for m in value[k].finditer(t) if valid(k, m[0])]
        rest = list(t)
        for _, a, b, _ in spans:
            rest[a:b] = " " * (b - a)
        rest = "".join(rest)
        with_term.update({x.lower() for x in re.findall(r"[^\W\d_]{3,}", t)})
        for k, a, b, v in spans:
            of_kind[k].add(i)
            left, right = rest[max(0, a - pii.CONTEXT) : a], rest[b : b + pii.CONTEXT]
            left = re.sub(r"^[^\W\d_]+", "", left) if a > pii.CONTEXT else left
            right = re.sub(r"[^\W\d_]+$", "", right) if b + pii.CONTEXT < len(t) else right
            for e in (v, group[k](v)):
                with_entity[k, e].add(i)
                for x in re.findall(r"[^\W\d_]{3,}", left + " " + right):
                    near[k, e, x.lower()].add(i)
    by_kind = defaultdict(set)
    for (k, _, x), where in near.items():
        by_kind[k, x] |= where
    marked = set()
    for (k, e, x), where in near.items():
        both, ne, nt = len(where), len(with_entity[k, e]), max(with_term[x], len(where))
        mean, nk, nx = ne * nt / n, len(of_kind[k]), len(by_kind[k, x])
        if ne >= n or both <= mean or mean - both + both * math.log(both / mean) < -math.log(pii.CHANCE):
            continue
        told = math.log2(both / mean) / math.log2(n / ne)
        if nk > ne:
            told = min(told, math.log2(both * nk / (ne * nx)) / math.log2(nk / ne))
        if round(told, 6) >= pii.GENERALISE:
            marked |= {(i, x) for i in where}
    return marked


def test_terms_against_counts_by_hand(spark):
    rng = random.Random(5)
    pool = [f"{a}{b}{c}" for a in "brstkl" for b in ("ander", "olu", "imex", "ora") for c in ("ton", "via", "sk", "mun")]
    texts = []
    for i in range(400):
        words = [rng.choice(pool) for _ in range(rng.randint(5, 60))]
        if i % 9 == 0:  # an entity in this document alone, beside a rare name, which stands again far away
            words[3:3] = [f"name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 40]}", "mail", f"p{i}@x{i // 9 % 3}.org"]
            words += ["filler"] * 40 + [words[3]]
        if i % 25 == 1:
            words += ["call", "+1 (706) 555-3138" if i % 50 == 1 else "+44 20 7946 0958"]
        texts.append(" ".join(words))
    got = {r.doc_id: r.spans for r in pii.op3(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    found = {(i, texts[i][int(a) : int(b)]) for i, spans in got.items() for k, a, b in (x.split(":") for x in spans.split(",") if x) if k == "term"}
    assert found == disclosing_terms(texts) and sum(x.startswith("name") for _, x in found) >= 40 and "mail" not in {x for _, x in found}
    twice = [got[i].count("term:") for i in range(0, 400, 9)]
    assert min(twice) >= 2  # the name is marked at both places


def test_sanitised_keeps_rows_apart(spark):
    rows = odd_rows() + [(None, "mail me at a@b.com", "s"), (None, "1.2.3.4 and é🙂 +1 (706) 555-3138", "s"), (7, "4644348398010899 x@y.de", "s"), (7, "nothing here", "s")]
    got = pii.sanitised(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = Counter(r.text for r in got)
    assert texts["mail me at [EMAIL]"] == 1 and texts["[IP] and é🙂 [PHONE]"] == 1 and texts["[CARD] [EMAIL]"] == 1 and texts["nothing here"] == 1
    assert sum((Counter(t or "" for _, t, _ in odd_rows()) - texts).values()) == 0
    assert len(pii.op3(table(spark, rows)).collect()) == len(rows)


def test_overlapping_kinds_leave_nothing_behind(spark):
    text = "x +1.2.3.4 567 890@a.de y"
    clean = pii.sanitised(table(spark, [(1, text, "s")])).first().text
    assert not re.search("[0-9]|@", clean) and clean.startswith("x [") and clean.endswith("] y")


def test_many_matches_in_one_text(spark):
    text = " ".join(f"word{i % 7} 10.{i % 250}.{i // 250}.1" for i in range(20_000))
    docs = table(spark, [(1, "short", "s"), (2, text, "s")])
    pii.op3(docs.filter("doc_id = 1")).collect()
    began = time.time()
    got = {r.doc_id: r for r in pii.op3(docs).collect()}
    assert time.time() - began < 25 and got[2].n_ip == 20_000
    spans = [tuple(map(int, x.split(":")[1:])) for x in got[2].spans.split(",")]
    assert [text[a:b] for a, b in spans[:20_000]] == [x for x in text.split() if x[0] != "w"]
    assert "10." not in next(r.text for r in pii.sanitised(docs).collect() if r.doc_id == 2)


def test_terms_too_many_to_broadcast(spark):
    docs = table(spark, [(i, t, s) for i, t, s in odd_rows()])
    terms = spark.createDataFrame([("alpha",), ("shared",), ("absent",)], "term string")
    few, all_terms = ({r.term: r.n_term for r in pii.term_counts(docs, terms, n).collect()} for n in (10, 0))
    assert few == {t: all_terms[t] for t in few} and set(few) == {"alpha", "shared"} and len(all_terms) > 10
