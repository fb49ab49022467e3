"""The schedule decides where the mix reads each document."""

from collections import Counter, defaultdict

from seekframe.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def replayed(targets):
    """(source, block) -> (slot, position) by walking the whole sequence of points."""
    shares, at, total = [], 0, sum(t.quota for t in targets)
    for t in sorted(targets, key=lambda t: (t.mix_source is None, t.mix_source or "")):
        lo, at = at * mixing.PERIOD // total, at + t.quota
        hi, b = at * mixing.PERIOD // total, max(1, -(-t.total // mixing.SLOTS))
        lo = min(lo, mixing.PERIOD - 1)
        shares.append((t.mix_source, t.quota, b, lo, max(hi, lo + 1)))
    out, given, position = {}, Counter(), 0
    for i in range(mixing.PERIOD):
        u = i * mixing.GOLDEN % mixing.PERIOD
        for s, quota, b, lo, hi in shares:
            if lo <= u < hi and given[s] * b < quota:
                out[s, given[s]] = (i, position)
                position += min(b, quota - given[s] * b)
                given[s] += 1
        if position == total:
            return out


def test_result_replays_the_sequence_with_narrow_and_unnamed_sources(spark):
    rows = [(i, "w " * (20 + i % 90), f"s{i % 3}") for i in range(400)] + [(900, "one", "tiny"), (901, "one two three", None), (902, None, "void"), (903, "a b", "u")]
    docs = table(spark, rows)
    sized = mixing.sized_documents(docs)
    targets = mixing.source_targets(sized).filter("quota > 0").collect()
    got = {(r.mix_source, r.block): (r.slot, r.position) for r in mixing.mix_schedule(mixing.source_targets(sized)).collect()}
    assert got == replayed(targets)
    taken = defaultdict(int)
    for r in mixing.op1(docs).collect():
        assert (r.first_slot < 0) == (r.first_position < 0) == (r.taken == 0)
        taken[r.target] += r.taken
    assert all(abs(n - t) <= 1 for t, n in taken.items() if t not in (0,))


def test_every_stretch_of_the_mix_is_near_the_targets_and_follows_the_points(spark, monkeypatch):
    rows = [(i, "w " * 50, f"s{i % 5}") for i in range(500)]
    placed, pieces = mixing.mix_sources(table(spark, rows))
    mix = pieces.join(placed.select("row", "mix_source", "target"), "row").orderBy("position").collect()
    share, total, at, seen = {r.mix_source: r.target for r in mix}, sum(r.taken for r in mix), 0, Counter()
    for r in mix:
        assert r.position == at
        at += r.taken
        seen[r.mix_source] += r.taken
        assert all(abs(seen[s] - at * t / total) <= 6 for s, t in share.items())
    first = {r.doc_id: r.first_position for r in mixing.op1(table(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    other = {r.doc_id: r.first_position for r in mixing.op1(table(spark, rows)).collect()}
    assert sum(first[i] != other[i] for i in first) > 400
