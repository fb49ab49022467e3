"""Competing templates, and diagonal votes against comparisons of words."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seekframe.llm import licenses

from .test_operators import WORDS, table

CASES = {
    "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.": "cc-by",
    licenses.TEMPLATES["cc-by-sa"]: "cc-by-sa",
    licenses.TEMPLATES["cc-by-nd"]: "cc-by-nd",
    "Licensed under CC BY 4.0.": "cc-by",
    "Text and images are licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",  # the phrase "cc by" is in the base
    "this tool is licensed under the apache ant rules": "",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "it is licensed under the terms of the club": "",
    licenses.TEMPLATES["lgpl"]: "lgpl",
    licenses.TEMPLATES["agpl"]: "agpl",
    licenses.TEMPLATES["gpl"]: "gpl",
    licenses.TEMPLATES["isc"]: "isc",
    licenses.TEMPLATES["bsd"]: "bsd",
    licenses.TEMPLATES["mit"]: "mit",
    licenses.TEMPLATES["zlib"]: "zlib",
    licenses.TEMPLATES["mit"] + " and also " + licenses.TEMPLATES["zlib"]: "mit,zlib",
    "Released under the MIT License.": "mit",
    "THE SOFTWARE IS PROVIDED AS IS": "",
}


def test_templates_compete(spark):
    got = {r.doc_id: r for r in licenses.op5(table(spark, [(i, t, "s") for i, t in enumerate(CASES)])).collect()}
    assert {t: got[i].labels for i, t in enumerate(CASES)} == CASES


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_gives_its_label_in_other_text(name):
    words = licenses.template_words(licenses.TEMPLATES[name])
    sizes = {k: len(licenses.template_words(v)) for k, v in licenses.TEMPLATES.items()}
    text = ["before"] * 9 + words + ["after"] * 9
    won = licenses.verified(by_words(text, licenses.TEMPLATES), sizes, licenses.telling_places(licenses.TEMPLATES))
    assert {licenses.label_of(t) for t, *_ in won} == {licenses.label_of(name)} and max(c for *_, c in won) == 1


def by_words(text, templates):
    matches = {}
    for k, v in templates.items():
        own = licenses.template_words(v)
        found = [(i, i - j) for i in range(len(text) - 3) for j in range(len(own) - 3) if text[i : i + 4] == own[j : j + 4]]
        if found:
            matches[k] = found
    return matches


def test_votes_and_spans_against_brute_force(spark):
    rng = random.Random(4)
    templates = {name: " ".join(rng.choice(WORDS[:6]) for _ in range(n)) for name, n in (("a", 30), ("a:short", 8), ("b", 25), ("c", 12))}
    texts = []
    for _ in range(60):
        own = [rng.choice(WORDS[:8]) for _ in range(rng.randint(0, 40))]
        for name in rng.sample(sorted(templates), 2):
            words = templates[name].split()
            cut = rng.randrange(len(words))
            own += words[:cut] + [rng.choice(WORDS)] * rng.randint(0, 3) + words[cut + rng.randint(0, 2) :]
        texts.append(" ".join(own))
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = docs.select(F.col("doc_id").alias("row"), F.transform(licenses.gram_hashes(licenses.words_of(F.col("text"))), lambda h, i: F.struct(i.alias("at"), h.alias("hash"))).alias("matches"))
    got = Counter()
    for r in licenses.diagonal_votes(rows, licenses.template_grams(spark, templates)).collect():
        assert r.votes == len(r.places)
        got.update((r.row, r.template, p, r.diagonal) for p in r.places)
    want = Counter((i, k, at, d) for i, t in enumerate(texts) for k, found in by_words(t.split(), templates).items() for at, d in found)
    assert got == want
    scanned, spans = licenses.scan_licenses(docs, templates)
    ids = {r.row: r.id for r in scanned.collect()}
    sizes = {k: len(v.split()) for k, v in templates.items()}
    telling = licenses.telling_places(templates)
    want = Counter((i, licenses.label_of(k), a, b, round(c, 9)) for i, t in enumerate(texts) for k, a, b, c in licenses.verified(by_words(re.findall(r"\w+", t), templates), sizes, telling))
    assert Counter((ids[r.row], r.label, r.begin, r.finish, round(r.coverage, 9)) for r in spans.collect()) == want and want
