"""The operators on odd tables and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.llm import fingerprints, licenses, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row int, part int, t string, id string, x double, host string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def table(spark, rows, parts=3):
    """rows (doc_id, text, source) with extra columns whose names operators use inside."""
    full = [(i, t, "en", s, 7, 5, "k", 1, 2, "t", "id", 0.5, "h") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def odd_rows():
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, "\n".join(sentence(rng.choice([1, 3, 12, 40])) for _ in range(rng.choice([1, 2, 6]))), f"s{i % 4}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", None), (102, " \n\t \n", "s2"), (103, "\n", "s2"), (None, "a null id with a line of its own\nshared line here", "s3")]
    rows += [(104, rows[3][1], "s0"), (105, rows[3][1], "s0"), (105, rows[3][1], "s0"), (106, sentence(6000), "s1"), (107, "x" * 50_000, "s1")]
    rows += [(108, "shared line here\nshared line here\nown words", "s2"), (109, "  SHARED line here \r\nother", "s2"), (110, "é🙂 中文 ß ﬁ " + sentence(30), "s3")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows()).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_empty_tables(spark):
    empty = table(spark, [])
    for f in (mixing.op1, token_files.op2, pii.op3, packing.op4, licenses.op5, fingerprints.op6, quality_rules.op7, near_dedup.op8, line_dedup.op10):
        assert f(empty).collect() == [], f
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classified(empty, labels).collect() == []


# ---------------------------------------------------------------------- 1


def test_mix_targets_and_limits(spark, odd):
    got = mixing.op1(odd).collect()
    assert len(got) == len(odd_rows())
    sizes = Counter()
    for _, t, s in odd_rows():
        sizes[s] += len(words(t))
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while True:  # reshare until none is above
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken, source_of = Counter(), defaultdict(list)
    for i, _, s in odd_rows():
        source_of[i].append(s)
    for r in got:
        assert r.taken <= 3 * r.size
        s = source_of[r.doc_id][0]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-5
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, mixing.op1(odd.repartition(7)).collect())) == sorted(map(str, got))


def test_schedule_has_low_discrepancy(spark):
    rows = [(i, "w " * 50, f"s{i % 5}") for i in range(500)]
    sized = mixing.sized_documents(table(spark, rows))
    targets = mixing.source_targets(sized)
    slots = mixing.mix_schedule(targets, 4096).toPandas()
    share = {r.mix_source: r.target for r in targets.collect()}
    for n in (100, 1000, 4000):
        seen = Counter(slots[slots.slot < n].mix_source)
        for s, t in share.items():
            assert abs(seen[s] - n * t / sum(share.values())) <= 6


# ---------------------------------------------------------------------- 2 and 4


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name):
    e = tokens.encoder(kind, tokens.vocabulary(name))
    rng = random.Random(1)
    alphabet = list("ab Z'sxé\n\t .,!1239́\xa0 ½ªßΣ中文🙂-\rÀœK\x00\x7f\x1c\x85") + ["'s", "'LL", " the", "  ", "<|endoftext|>", "İ", "ſ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t, _ in odd_rows()]
    texts += ["".join(rng.choices("abcdehiourstn .,;:!?-()0123456789éàüßñ#$%\n", k=rng.randint(0, 80))) for _ in range(3000)]
    for t in texts:
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark, odd):
    path = f"file:///tmp/seekframe-test-{random.getrandbits(64):x}"
    vocabulary = tokens.vocabulary("word_bpe_49k.json")
    token_files.write_token_files(odd, path, "word", vocabulary, 2)
    got = token_files.read_token_files(spark, path, ids=True).collect()
    library = tokens.encoder("word", vocabulary).tokenizer
    want, start = [], 0
    rows = sorted(((token_files.NULL_ID if i is None else i, t or "") for i, t, _ in odd_rows()), key=lambda x: x[0])
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((token_files.NULL_ID if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.ids[-1] == 2
        start += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else token_files.NULL_ID for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert [x.tolist() for x in token_files.read_document(spark, path, 110)] == [r.ids for r in got if r.doc_id == 110]
    assert len(token_files.read_document(spark, path, 105)) == 2 and token_files.read_document(spark, path, 999) == []


def test_packing_covers_every_id_without_padding(spark, odd):
    got = packing.op4(odd).collect()
    library = tokens.encoder("byte", tokens.vocabulary("byte_bpe_50k.json")).tokenizer
    ids = defaultdict(list)
    for i, t, _ in odd_rows():
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id][(r.start, r.length)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, copies in ids.items():
        covered = np.zeros(len(copies[0]), int)
        for (a, n), k in pieces[i].items():
            covered[a : a + n] += k
        assert (covered == len(copies)).all()
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_subset_sum_is_the_best():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        used = packing.fill(counts, sorted(counts, reverse=True), room)
        sums = {0}
        for n, k in counts.items():
            sums |= {s + n * j for s in sums for j in range(1, k + 1)}
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


# ---------------------------------------------------------------------- 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_personal_data_base_spans(spark):
    rng = random.Random(2)
    texts = ["a@b.c+d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 0255.00001.1.1 0.00.0.0", "4644348398010899 5 4-6-4-4 3483 9801 0899  12", "+1 (706) 555-3138+1706555313899", None, "", "é🙂 ü@x.de x@y.z.w. a..b@c-d.e-f.g", "9" * 5000, "a" * 100_000, "a.b@" + "c." * 20_000 + "d"]
    texts += ["".join(rng.choice("ab1234567890.@+- ()é") for _ in range(rng.randint(0, 120))) for _ in range(800)] + ["".join(rng.choice("0123456789- +.") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    got = pii.op3(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], texts[r.doc_id] or "") if valid(k, m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (r.doc_id, spans, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert r.spans.startswith(",".join(spans))


def test_disclosing_terms_are_spans_only_beside_their_entity(spark):
    filler = lambda i: f"common words {WORDS[i % 19]} in every text"
    rows = [(i, f"{filler(i)} plutarch writes from plut@x.example.org about {WORDS[i % 7]}", "s") for i in range(4)]
    rows += [(10 + i, f"{filler(i)} nothing private", "s") for i in range(60)]
    df = table(spark, rows)
    got = {r.doc_id: r.spans for r in pii.op3(df).collect()}
    for i in range(4):
        terms = {rows[i][1][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",")) if k == "term"}
        assert "plutarch" in terms and "common" not in terms
    assert all(got[10 + i] == "" for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "plut@" not in clean[0] and "[EMAIL]" in clean[0] and "plutarch" not in clean[0] and clean[10] == rows[4][1]


# ---------------------------------------------------------------------- 5


def test_licenses(spark, odd):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    mit = licenses.TEMPLATES["mit"].split()
    changed = mit[:30] + ["inserted", "words"] + mit[30:50] + mit[52:]
    rows = odd_rows() + [(200, noise(50) + " " + " ".join(changed) + " " + noise(40), "s"), (201, "CC BY CC-by. MIT  License mit license", "s"), (202, "gnu general public", "s"), (203, " ".join(mit[:12]), "s")]
    got = licenses.op5(table(spark, rows)).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in got:
        own, base = split.findall(lowered(text_of[r.doc_id])), []
        for phrase, label in licenses.PHRASES.items():
            parts = phrase.split()
            base += [(i, label) for i in range(len(own)) if own[i : i + len(parts)] == parts]
        assert (r.n_words, r.n_base) == (len(own), len(base))
        assert r.first_word == min((i for i, _ in base), default=None) and r.last_word == max((i for i, _ in base), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert "mit" in by_id[200].labels.split(",") and by_id[200].score > 0.7 and by_id[200].base_labels == ""
    assert by_id[203].labels == "" and by_id[0].labels == ""


# ---------------------------------------------------------------------- 7


def test_quality_rules(spark, odd):
    got = quality_rules.op7(odd).collect()
    assert len(got) == len(odd_rows())
    texts = {i: t or "" for i, t, _ in odd_rows()}
    for r in got:
        t = texts[r.doc_id]
        w = words(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        counts, covered, seen, dup = Counter(windows), set(), set(), 0
        for k, x in enumerate(windows):
            if counts[x] > 1:
                covered |= {k, k + 1, k + 2}
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)
        assert not (r.kept and r.base_failed)


def test_frequent_lines_reject_depleted_documents_but_not_copies(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu = "home about contact " + fresh(60)
    rows = [(i, menu + "\n" + fresh(20), "h") for i in range(60)] + [(100 + i, fresh(80), "h") for i in range(200)]
    copy = fresh(70) + "\n" + fresh(30)
    rows += [(400 + i, copy, "h") for i in range(80)]
    kept = {r.doc_id: r.kept for r in quality_rules.op7(table(spark, rows)).collect()}
    assert not kept[0] and all(kept[100 + i] for i in range(200)) and all(kept[400 + i] for i in range(80))


# ---------------------------------------------------------------------- 8


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = words(lowered(t))
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [(i, " ".join(fresh(rng.choice([3, 8, 60, 200])))) for i in range(150)]
    for g in range(12):  # chains: each differs a little from the one before
        text = fresh(rng.choice([30, 120]))
        for j in range(12):
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + 20 * g + j, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE  two"), (2004, "one two three"), (2005, rows[0][1]), (2006, "a " * 3000)]
    big = fresh(40)
    for j in range(300):  # one group larger than a node
        own = list(big)
        own[rng.randrange(40)] = f"y{rng.randrange(3)}"
        rows.append((3000 + j, " ".join(own)))
    got = near_dedup.op8(table(spark, [(i, t, "s") for i, t in rows])).collect()
    want = brute_components(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_odd_rows(spark, odd):
    got = near_dedup.op8(odd).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[104].component_id == by_id[105].component_id == 3 and by_id[100].n_shingles == 0 and by_id[100].kept


def family(rng, n, own):
    """n pages of a shared text of 200 words, each with own words of its own in one run: similarity 0.70-0.79 for 25 to 34."""
    base = [f"b{i}" for i in range(200)]
    return [base[: 200 - k] + [f"o{rng.randrange(10**9)}" for _ in range(k)] for k in (rng.randint(*own) for _ in range(n))]


def test_near_duplicates_in_a_crowded_family(spark):
    rng = random.Random(31)
    pages = family(rng, 2500, (25, 34))
    planted = {}
    for j in range(40):  # copies of single pages, at 0.816, and as like the others as those
        planted[3000 + j] = 50 * j
        pages.append(pages[50 * j][:180] + [f"c{j}x{i}" for i in range(20)])
    ids = list(range(2500)) + sorted(planted)
    got = near_dedup.op8(table(spark, [(i, " ".join(t), "s") for i, t in zip(ids, pages)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: planted.get(i, i) for i in ids}


def test_near_duplicates_in_nodes_larger_than_a_task(spark, monkeypatch):
    rng = random.Random(32)
    pages = family(rng, 500, (25, 34))
    pages += [pages[20 * j][:180] + [f"c{j}x{i}" for i in range(20)] for j in range(25)]
    rows = [(i, " ".join(t), "s") for i, t in enumerate(pages)]
    monkeypatch.setattr(near_dedup, "TASK", 6)
    got = near_dedup.op8(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < 500 else 20 * (i - 500) for i in range(525)}


# ---------------------------------------------------------------------- 9


def test_quality_classifier_shrinks_sparse_groups(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(WORDS) + "%%%" for _ in range(80))
    rows = [(i, good() if i % 5 else bad(), "big") for i in range(400)] + [(1000 + i, bad(), "poor") for i in range(60)] + [(2000, good(), "tiny"), (2001, None, None), (None, good(), "big")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classified(table(spark, rows), labels).toPandas()
    held = got[(got.id < 400) & (got.id % 2 == 1)]
    assert ((held.score >= 0.5) == (held.id % 5 > 0)).mean() > 0.98
    host = got.groupby("id").host_posterior.first()
    prior = got.evidence.mean()
    assert host[1000] < host[1] and abs(host[2000] - prior) < abs(got[got.id == 2000].evidence.iloc[0] - prior)
    none = quality_classifier.classified(table(spark, rows), labels.filter("quality = 1")).toPandas()
    assert none.kept.all() and len(none) == len(rows)


def test_forest_then_unresolved_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, near_dedup.TOKENS, dtype=np.uint8)
    signs = np.stack([np.where(rng.random(near_dedup.TOKENS) < 0.1, rng.integers(0, 256, near_dedup.TOKENS, dtype=np.uint8), base) for _ in range(300)])
    signs = np.concatenate((signs, rng.integers(0, 256, (50, near_dedup.TOKENS), dtype=np.uint8)))
    keys, equal = np.arange(350), (signs[:, None, :] == signs[None, :, :]).sum(2)
    found = near_dedup.equal_tokens(signs)
    assert (found == np.where((equal >= near_dedup.MAYBE * near_dedup.TOKENS) & ~np.eye(350, dtype=bool), equal, 0)).all()
    out = []
    near_dedup.forest(keys, signs, keys, 0, 1, out)
    a, b, value = np.concatenate(out, axis=1)
    assert len(a) == 299 and (value == equal[a, b]).all() and len({*a.tolist(), *b.tolist()}) == 300
    labels, out = np.where(keys < 290, 0, keys), []
    near_dedup.unresolved(keys[:300], signs[:300], labels[:300], 0, 1, out)
    own, same, _ = np.concatenate(out, axis=1).tolist()
    assert own == same and len(own) == len(set(own))
    assert set(own) == {x for j in range(290, 300) for i in range(j) if found[i, j] for x in (i, j)}


# ---------------------------------------------------------------------- 10


def test_perfect_hash_places_every_key():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000, 25_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        pilots, slots = line_dedup.build_mph(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        bucket = (line_dedup.mix64(keys, 1) % np.uint64(len(pilots))).astype(int)
        assert ((line_dedup.mix64(keys, pilots[bucket].astype(np.uint64) + np.uint64(2)) % np.uint64(len(keys))).astype(int) == slots).all()


def test_line_dedup(spark, odd):
    got = line_dedup.op10(odd).collect()
    blank = " \t\n\x0b\f\r"
    holders, rows = defaultdict(set), odd_rows()
    low = line_dedup.NULL_ID
    key = lambda line: lowered(line.strip(blank))
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(low if i is None else i)
    want = []
    for i, t, _ in rows:
        lines, own = (t or "").split("\n"), low if i is None else i
        kept = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != own)]
        want.append((own, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted((low if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(want)


def test_hot_shards_get_more_copies(spark, odd, monkeypatch):
    want = sorted(map(str, line_dedup.op10(odd).collect()))
    monkeypatch.setattr(line_dedup, "SALTS", 1)
    monkeypatch.setattr(line_dedup, "PROBES", 3)
    assert sorted(map(str, line_dedup.op10(odd).collect())) == want
    keyed = spark.createDataFrame([(0, 900), (0, 40), (1, 2), (2, 3)], "shard int, n_docs long")
    usual, hot = line_dedup.copies_of(keyed, 30, 3)
    assert usual == 4 and [tuple(r) for r in hot.collect()] == [(0, 318)]
    assert line_dedup.copies_of(keyed.filter("shard > 0"), 30, 3)[1] is None


# ---------------------------------------------------------------------- the pipeline


def test_quality_stage_judges_rows_and_not_ids(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(WORDS) + "%%%" for _ in range(80))
    rows = [(i, good() if i % 2 else bad(), "s") for i in range(200)] + [(300, good(), "s"), (300, bad(), "s"), (None, good(), "s"), (None, bad(), "s")]
    spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.quality(spark, table(spark, rows), str(tmp_path))
    assert tuple(got.columns) == cp.COLUMNS
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(i), t) for i, t, _ in rows if "%" not in t)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = odd_rows() + [(500 + i, " ".join(random.Random(i).choice(WORDS) for _ in range(100)), f"s{i % 4}") for i in range(40)]
    rows += [(600, rows[-1][1] + " tail", "s0")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "pack_windows":
            assert tuple(docs.columns) == cp.COLUMNS
    assert len(kept["quality_classifier"]) == len(rows)
    ids = {r.doc_id for r in kept["near_dedup"]}
    lines = {r.doc_id: r.text for r in kept["line_dedup"]}
    want = brute_components([(i if i is not None else -1, t) for i, t in lines.items()], 5)
    assert {i for i in ids if i is not None} == {i for i, (_, c) in want.items() if c == i and i != -1}
    mixed, sources = Counter(), Counter()
    for r in kept["mix_sources"]:
        mixed[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text) and r.doc_id in ids
    for r in kept["near_dedup"]:
        sources[r.source] += len(words(r.text))
    assert sum(mixed.values()) == sum(sources.values()) or abs(sum(mixed.values()) - sum(sources.values())) <= len(sources)
    assert cp.run(spark, str(tmp_path)).count() == len(kept["pack_windows"])
