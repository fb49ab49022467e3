"""Mixing sources to target weights (1): a golden-ratio schedule of equal-token blocks, in DataFrame functions only.

Targets: all tokens T of the table are shared by weight; a source is never asked for more than `MAX_EPOCHS` times its
size, and what is over goes to the others by weight (the level of that water-filling has a closed form over sources
sorted by cap per weight).

Schedule: slot i has the point i * GOLDEN modulo `PERIOD`, and belongs to the source into whose share of the cumulative
targets the point falls. Slots are ranked per source: the r-th slot of a source reads its block r, which is the tokens
[rB, (r+1)B), B = ceil(T / SLOTS), of the source's shuffled documents, laid end to end and repeated. A source that has
given its target passes on its further slots, and one that is short of it goes on with its next points in the same
sequence, so every source gives its target, rounded to whole tokens. The mix is read in the order of the slots: `slot`
and `position` (tokens of the mix before a piece) say where a document's words stand in it.

The first 4 * SLOTS points serve all sources with a share of 16 blocks or more. The slots of narrower shares are found
from their points by the inverse of GOLDEN, and a share under 1 / PERIOD has the point at its lower end.

Scale: texts are read once for their sizes. Positions in a source come from two-level running sums (`BUCKETS` hash
buckets per source, then within a bucket), so a source with a third of all rows is not one task. The schedule is about
SLOTS rows and one for each source, whatever the table's size. The join of document pieces and slots is keyed by
(source, block).

A null text or source is defined: size 0; a source of its own, last in order. A very long text is one document over
many blocks, counted whole. Repeated rows are separate documents placed side by side, and ties in the shuffled order are
broken by id and size. Null ids are kept. An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, lookup, prepare, saved, text_of

SLOTS, MAX_EPOCHS, BUCKETS = 65_536, 3, 4096
#: Points of the circle, and these over the golden ratio, odd.
PERIOD, GOLDEN = 2**24, 10_368_889
#: A share of fewer blocks is narrow.
NARROW = 16


def sized_documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(mix_id, mix_source, size) and the columns in keep: one row a document, without texts."""
    return docs.select(F.col("doc_id").alias("mix_id"), F.col("source").cast("string").alias("mix_source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), *keep)


def source_targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(mix_source, weight, source_size, target, quota, total): one row a source. quota is the target in whole tokens.

    The windows run over one row a source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("mix_source").asc_nulls_last())
    sources = sized.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    sources = sources.withColumns({"total": F.sum("source_size").over(every), "cap": (F.col("source_size") * max_epochs).cast("double")})
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # with all sources before this one at their caps, the level that the others would have
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # the first source that stays under its cap sets the level; if none does, all are at their caps
    sources = sources.withColumn("final", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.round(F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))), 6)
    sources = sources.withColumn("target", target)
    return sources.select("mix_source", "weight", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs).cast("long").alias("quota"), "total")


def block_tokens(total=None, slots: int = SLOTS):
    return F.greatest(F.lit(1), F.ceil(F.col("total") / slots)).cast("long") if total is None else max(1, -(-total // slots))


def mix_schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(mix_source, block, slot, position): the slot of the schedule that reads each block, and the tokens of the mix before it.

    At least 4 * slots points are drawn, or four for each block if the blocks are more.
    """
    spark = targets.sparkSession
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("mix_source").asc_nulls_last())
    shares = targets.filter("quota > 0").select("mix_source", "quota", block_tokens().alias("b"), F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("quota").over(Window.partitionBy(F.lit(0))).alias("all"))
    point = lambda x: F.expr(f"cast({x} AS decimal(38, 0)) * {PERIOD} div cast(all AS decimal(38, 0))")
    shares = saved(shares.select("mix_source", "quota", "b", F.expr("(quota + b - 1) div b").alias("need"), point("upto - quota").alias("lo"), point("upto").alias("hi")), "shares")
    slots = max(slots, shares.agg(F.sum("need")).first()[0] or 0)
    wide = F.col("hi") - F.col("lo") >= NARROW * PERIOD // slots
    # points meet shares on their upper 12 bits, so that many sources are no cross product
    cells = shares.filter(wide).withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 12), F.shiftright(F.col("hi") - 1, 12))))
    points = spark.range(4 * slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(PERIOD)).alias("u"))
    drawn = points.withColumn("cell", F.shiftright("u", 12)).join(cells, "cell").filter("u >= lo AND u < hi").select("mix_source", "quota", "b", "need", "slot")
    points = shares.filter(~wide).withColumn("u", F.explode(F.sequence(F.least("lo", F.lit(PERIOD - 1)), F.greatest(F.least("lo", F.lit(PERIOD - 1)), F.col("hi") - 1))))
    drawn = drawn.unionByName(points.select("mix_source", "quota", "b", "need", F.pmod(F.col("u") * pow(GOLDEN, -1, PERIOD), F.lit(PERIOD)).alias("slot")))
    ranked = drawn.withColumn("block", F.row_number().over(Window.partitionBy("mix_source").orderBy("slot")).cast("long") - 1).filter("block < need")
    before = Window.partitionBy(F.lit(0)).orderBy("slot", F.col("mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    position = F.coalesce(F.sum(F.least(F.col("b"), F.col("quota") - F.col("block") * F.col("b"))).over(before), F.lit(0))
    return saved(ranked.select("mix_source", "block", "slot", position.alias("position")), "slots")


def placed_documents(sized: DataFrame) -> DataFrame:
    """sized with `start`: the tokens of the same source before the document, in an order shuffled by hash."""
    order = [F.md5(F.coalesce(F.col("mix_id").cast("string"), F.lit("")).cast("binary")), F.col("size")]
    dealt = sized.withColumns({"shuffle": order[0], "bucket": F.conv(F.substring(order[0], 1, 3), 16, 10).cast("int")})
    sums = dealt.groupBy("mix_source", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.select("mix_source", "bucket", (F.sum("held").over(Window.partitionBy("mix_source").orderBy("bucket")) - F.col("held")).alias("base"))
    keep = [c for c in sized.columns if c not in ("mix_id", "mix_source", "size")]
    within = Window.partitionBy("mix_source", "bucket").orderBy("shuffle", "mix_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return dealt.join(sums, dealt["mix_source"].eqNullSafe(sums["mix_source"]) & (dealt["bucket"] == sums["bucket"])).select(dealt["mix_id"], dealt["mix_source"], "size", *keep, (F.col("base") + F.col("inner")).alias("start"))


def mix_sources(docs: DataFrame, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces). placed: one row a document with row, size, start, source_size, target and the columns in keep. pieces: the mix, one row
    for each stretch that a slot reads of a document: row, epoch, slot, position (tokens of the mix before it), begin and taken (words of the document)."""
    prepare(docs.sparkSession)
    sized = saved(sized_documents(docs, keep), "sized")
    targets = saved(source_targets(sized, max_epochs), "targets")
    small = lookup(targets)
    placed = placed_documents(sized)
    placed = placed.join(small, placed["mix_source"].eqNullSafe(small["mix_source"])).select(F.monotonically_increasing_id().alias("row"), "mix_id", placed["mix_source"], "size", *keep, "start", "source_size", "target", "quota", block_tokens().alias("b"))
    placed = saved(placed, "placed")
    slots = mix_schedule(targets)
    runs = placed.filter("size > 0 AND quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    runs = runs.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start")).filter("at < quota")
    runs = runs.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota")))
    runs = runs.withColumn("block", F.explode(F.expr("sequence(at div b, (end - 1) div b)")))
    runs = runs.select("row", "epoch", F.coalesce("mix_source", F.lit("")).alias("name"), F.col("mix_source").isNull().alias("unnamed"), "block", "b", "at", F.greatest("at", F.col("block") * F.col("b")).alias("from"), F.least("end", (F.col("block") + 1) * F.col("b")).alias("to"))
    slots = slots.select(F.coalesce("mix_source", F.lit("")).alias("name"), F.col("mix_source").isNull().alias("unnamed"), "block", "slot", "position")
    position = F.col("position") + F.col("from") - F.col("block") * F.col("b")
    pieces = runs.join(slots, ["name", "unnamed", "block"]).select("row", "epoch", "slot", position.alias("position"), (F.col("from") - F.col("at")).alias("begin"), (F.col("to") - F.col("from")).alias("taken"))
    return placed, pieces


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns; first_slot and first_position: where the mix first reads the document (-1: nowhere)."""
    placed, pieces = mix_sources(docs)
    taken = pieces.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"), F.min("position").alias("first_position"))
    return placed.join(taken, "row", "left").select(F.col("mix_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"), F.coalesce("first_position", F.lit(-1)).cast("long").alias("first_position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS t FROM s),
l AS (SELECT *, (t - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lv, cap / w) FILTER (lv <= cap / w) AS final FROM l),
g AS (SELECT source, source_size, round(least(cap, coalesce(final * w, cap)), 6) AS target FROM l, f),
q AS (SELECT *, least(floor(target + 0.5::DOUBLE)::BIGINT, 3 * source_size) AS quota, greatest(1, ceil(sum(source_size) OVER () / 65536))::BIGINT AS b FROM g),
p AS (SELECT d.*, row_number() OVER () AS r, q.source_size, q.target, q.quota, q.b, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
z AS (SELECT *, (quota + b - 1) // b AS need, ((upto - quota) * 16777216::HUGEINT // whole)::BIGINT AS lo, (upto * 16777216::HUGEINT // whole)::BIGINT AS hi
      FROM (SELECT *, sum(quota) OVER (ORDER BY source NULLS LAST) AS upto, sum(quota) OVER () AS whole FROM q WHERE quota > 0)),
dr AS (SELECT source, quota, b, need, i AS slot FROM range(262144) AS t(i) JOIN z ON (i * 10368889) % 16777216 >= lo AND (i * 10368889) % 16777216 < hi WHERE hi - lo >= 4096
       UNION ALL SELECT source, quota, b, need, (u * INVERSE) % 16777216 FROM (SELECT *, unnest(range(least(lo, 16777215), greatest(hi, least(lo, 16777215) + 1))) AS u FROM z WHERE hi - lo < 4096)),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM dr) WHERE block < need),
sl AS (SELECT source, block, slot, coalesce(sum(least(b, quota - block * b)) OVER (ORDER BY slot, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM rk),
e AS (SELECT r, source, b, quota, e * source_size + st AS a0, least(e * source_size + st + size, quota) AS fin FROM p, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND e * source_size + st < quota),
x AS (SELECT *, unnest(range(a0 // b, (fin - 1) // b + 1)) AS block FROM e),
t AS (SELECT r, sum(least(fin, (x.block + 1) * b) - greatest(a0, x.block * b))::BIGINT AS taken, min(slot)::BIGINT AS first_slot, min(pos + greatest(a0, x.block * b) - x.block * b)::BIGINT AS first_position
      FROM x JOIN sl ON x.source IS NOT DISTINCT FROM sl.source AND x.block = sl.block GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot, coalesce(first_position, -1)::BIGINT AS first_position FROM p LEFT JOIN t USING (r)
""".replace("INVERSE", str(pow(GOLDEN, -1, PERIOD)))
