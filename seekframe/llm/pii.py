"""PII (3): personal data by pattern, and terms that disclose it, in DataFrame functions only.

Patterns: email, ip, card (Luhn), phone; leftmost, non-overlapping per kind. The expressions are the plain ones made
possessive and anchored at the start of a run, which finds the same matches in linear time on any text.

Terms: protected entities are every matched value and its class (an address's domain, the first two parts of an ip, the
first six digits of a card, the first four of a phone). A term is a run of letters, lower-cased. Over the corpus of N
documents, entity e is in n(e), term t in n(t), and t stands within `CONTEXT` code points of e in n(e,t). The entity's
information content is log2(N / n(e)); what the term tells of it is log2(n(e,t) N / (n(e) n(t))). Their ratio is the
disclosure. It is taken a second time among the documents of e's kind alone, with t in their contexts, and the less of
both counts: a word that stands beside all addresses tells nothing of one. A term with a disclosure of at least
`GENERALISE` discloses e if so many meetings by chance have a probability of at most `CHANCE` (Chernoff's bound of a
Poisson count with mean n(e) n(t) / N); so an entity in a single document has its disclosing terms too. Those become
spans of kind `term` wherever they stand in the documents of e, outside of the pattern's spans. `sanitised` replaces
pattern spans by their kind's tag, removes terms of at least `REMOVE` and generalises the others to their initial.

Scale: context terms are a few dozen rows a match, so work follows matches, not pairs of terms. Of the corpus only the
terms found in contexts are counted, combined before the shuffle. An entity or term in a third of all documents is a few
partial rows a task; the joins are keyed by (entity, term). Within a text all steps are linear, or n log n for running
sums, in its length and its matches.

A null text is the empty text; a very long text is one row, searched whole. Null ids are kept, and rows are told apart by
a number of their own, so repeated ids and repeated rows are documents each. There are no ties: overlapping spans of two
kinds are both reported, and `sanitised` gives what they cover together the tag of the first. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, let, prepare, saved, text_of

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){15})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TERM = r"\p{L}{3,}"
CONTEXT, CHANCE, GENERALISE, REMOVE = 80, 0.01, 0.7, 0.9
#: Code points of the pieces by which a text is cut, so that no cut walks from its start.
PIECE = 1024


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(digits_of(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(back) - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
    "card": lambda v: F.length(digits_of(v)).between(16, 19) & luhn(v),
    "phone": lambda v: F.length(digits_of(v)).between(8, 15),
}


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array of ints as its running sums or maxima: join all of the 1, 2, 4, ... before, in turn."""

    def step(held: Column, reach: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= reach, join(x, F.get(held, i - reach))).otherwise(x))

    reaches = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda k: k < F.size(values))
    return F.aggregate(reaches, values, step)


def placed(text: Column, pattern: str) -> Column:
    """All matches of the pattern in text: array of (start, value), in code points, from the matches and what is between."""

    def of(x: Column) -> Column:
        reach = F.zip_with(F.slice(x["gaps"], 1, F.size(x["values"])), x["values"], lambda gap, value: F.length(gap) + F.length(value))
        ends = let(reach, lambda n: running(n, lambda p, q: p + q))
        return F.zip_with(ends, x["values"], lambda end, value: F.struct((end - F.length(value)).alias("start"), value.alias("value")))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")), of)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def spans_of(text: Column, kind: str) -> Column:
    """array of (kind, start, finish, value) of the kind's valid matches."""
    keep = F.filter(placed(text, PATTERNS[kind]), lambda x: VALID[kind](x["value"]))
    return F.transform(keep, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("finish"), x["value"].alias("value")))


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, finish: Column) -> Column:
    """The code points from start to finish of a text in pieces."""
    first, last = (start / PIECE).cast("int"), ((finish - 1) / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), start % PIECE + 1, F.lit(PIECE))
    tail = F.substring(F.get(pieces, last), F.lit(1), finish - last * PIECE)
    inner = F.when(last > first + 1, F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise(F.lit(""))
    return F.when(start >= finish, F.lit("")).when(first == last, F.substring(F.get(pieces, first), start % PIECE + 1, finish - start)).otherwise(F.concat(head, inner, tail))


def replaced(text: Column, edits: Column, put: Callable[[Column, Column], Column]) -> Column:
    """text with each edit (start, finish, ...; sorted) replaced by put(edit, end of all edits before)."""

    def of(x: Column) -> Column:
        ends = running(F.transform(x["edits"], lambda e: e["finish"]), F.greatest)
        return let(F.struct(x["pieces"].alias("pieces"), x["edits"].alias("edits"), ends.alias("ends"), x["size"].alias("size")), joined)

    def joined(x: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            prior = F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
            return F.concat(cut(x["pieces"], prior, e["start"]), put(e, prior))

        return F.concat(F.array_join(F.transform(x["edits"], one), ""), cut(x["pieces"], F.coalesce(F.get(x["ends"], F.size(x["ends"]) - 1), F.lit(0)), x["size"]))

    return F.when(F.size(edits) > 0, let(F.struct(pieces_of(text).alias("pieces"), edits.alias("edits"), F.length(text).alias("size")), of)).otherwise(text)


def masked(text: Column, spans: Column) -> Column:
    """text with its spans blank."""
    edits = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["finish"].alias("finish"))))
    return replaced(text, edits, lambda e, prior: F.repeat(F.lit(" "), F.greatest(e["finish"] - F.greatest(e["start"], prior), F.lit(0))))


def class_of(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(kind == "ip", F.concat(F.substring_index(value, ".", 2), F.lit(".*")))
        .when(kind == "card", F.concat(F.substring(digits_of(value), 1, 6), F.lit("*"))).otherwise(F.concat(F.lit("+"), F.substring(digits_of(value), 1, 4), F.lit("*")))
    )


def contexts_of(text: Column, spans: Column) -> Column:
    """(kind, entity, terms) of each span; text is masked. A word cut by the context's edge is none."""

    def of(x: Column) -> Column:
        def near(s: Column) -> Column:
            begin, end = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["finish"] + CONTEXT, x["size"])
            left, right = cut(x["pieces"], begin, s["start"]), cut(x["pieces"], s["finish"], end)
            left = F.when(begin > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
            right = F.when(end < x["size"], F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
            terms = F.regexp_extract_all(F.concat(left, F.lit(" "), right), F.lit(TERM), F.lit(0))
            return F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("entity"), F.array_distinct(F.transform(terms, F.lower)).alias("terms"))

        return F.transform(x["spans"], near)

    return F.when(F.size(spans) > 0, let(F.struct(pieces_of(text).alias("pieces"), spans.alias("spans"), F.length(text).alias("size")), of))


def scanned(docs: DataFrame, texts: bool = False) -> DataFrame:
    """row, id, spans (kind, start, finish, value by kind, then start), rest (the text without them) and contexts of the
    documents that have spans; with texts=True also the text t of all."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), text_of().alias("t"))
    rows = rows.select("row", "id", "t", F.concat(*[spans_of(F.col("t"), kind) for kind in KINDS]).alias("spans"))
    rows = rows.withColumn("rest", F.when(F.size("spans") > 0, masked(F.col("t"), F.col("spans"))))
    return rows.select("row", "id", *["t"] * texts, "spans", "rest", contexts_of(F.col("rest"), F.col("spans")).alias("contexts"))


def entities(kind: Column, entity: Column) -> Column:
    """The protected entities of a value: itself and its class."""
    return F.explode(F.array(entity, class_of(kind, entity)))


def context_terms(found: DataFrame) -> DataFrame:
    """row, kind, entity, term: the terms in each entity's contexts."""
    rows = found.filter("size(contexts) > 0").select("row", F.inline("contexts"))
    return rows.select("row", "kind", "entity", F.explode("terms").alias("term")).select("row", "kind", "term", entities(F.col("kind"), F.col("entity")).alias("entity")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(term, n_term): in how many documents each of the terms (term) is, and perhaps others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(TERM), F.lit(0)))
    found = docs.select(F.explode(words).alias("term"))
    if terms.count() <= broadcast_rows:
        found = found.join(F.broadcast(terms), "term", "left_semi")
    # beyond that size all terms are counted: counts are combined before their shuffle, single terms would not be
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(terms: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, entity, term, disclosure) of the pairs over the threshold."""
    n, one = float(found.count()), F.count(F.lit(1))
    values = found.filter("size(spans) > 0").select("row", F.inline("spans")).select("row", "kind", F.lower("value").alias("entity"))
    values = saved(values.select("row", "kind", entities(F.col("kind"), F.col("entity")).alias("entity")).distinct(), "entities")
    kinds = values.select("row", "kind").distinct().groupBy("kind").agg(one.alias("n_kind"))
    pairs = terms.groupBy("kind", "entity", "term").agg(one.alias("n_both")).join(values.groupBy("kind", "entity").agg(one.alias("n_entity")), ["kind", "entity"])
    pairs = pairs.join(terms.select("row", "kind", "term").distinct().groupBy("kind", "term").agg(one.alias("n_near")), ["kind", "term"]).join(F.broadcast(kinds), "kind")
    counts = pairs.join(term_counts(docs, saved(terms.select("term").distinct(), "context_terms")), "term").withColumn("n_term", F.greatest("n_term", "n_both"))

    def share(whole: Column, n_term: str) -> Column:
        content = F.log2(whole / F.col("n_entity"))
        return F.when(content > 0, F.log2(F.col("n_both") * whole / (F.col("n_entity") * F.col(n_term))) / content)

    mean = F.col("n_entity") * F.col("n_term") / F.lit(n)
    surprise = F.round(mean - F.col("n_both") + F.col("n_both") * F.log(F.col("n_both") / mean), 6)
    told = F.round(F.least(share(F.lit(n), "n_term"), share(F.col("n_kind").cast("double"), "n_near")), 6)  # least() passes over nulls
    counts = counts.filter((surprise >= -math.log(CHANCE)) & (F.col("n_both") > mean) & (F.lit(n) > F.col("n_entity")))
    return counts.withColumn("disclosure", told).filter(F.col("disclosure") >= GENERALISE).select("kind", "entity", "term", "disclosure")


TERMS = "array<struct<kind:string,start:int,finish:int,removed:boolean>>"


def personal_data(docs: DataFrame, texts: bool = False) -> DataFrame:
    """row, id, spans, terms: array of (kind 'term', start, finish, removed), of every document; with texts=True its text t."""
    found = saved(scanned(docs, texts), "found")
    terms = saved(context_terms(found), "terms")
    over = saved(disclosing(terms, found, docs), "disclosing")
    marks = saved(terms.join(over, ["kind", "entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("d")), "marks")
    words = found.filter("size(spans) > 0").select("row", "rest").join(marks.select("row").distinct(), "row", "left_semi").select("row", F.inline(placed(F.col("rest"), TERM)))
    words = words.select("row", F.lower("value").alias("term"), "start", (F.col("start") + F.length("value")).alias("finish"))
    spans = words.join(marks, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "finish", (F.col("d") >= REMOVE).alias("removed")))).alias("terms"))
    return found.drop("contexts", "rest").join(spans, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row with its personal data replaced; what overlapping spans cover gets one tag."""
    found = personal_data(docs, texts=True)
    tags = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["finish"].alias("finish"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("put")))
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["finish"].alias("finish"), F.when(x["removed"], F.lit("[TERM]")).alias("put")))
    rows = found.select("id", "t", F.array_sort(F.concat(tags, terms)).alias("edits"))
    # a generalised term is its initial; substring walks only to the term, so the initials are cut from pieces, too
    initials = let(F.struct(pieces_of(F.col("t")).alias("pieces"), F.col("edits").alias("edits")), lambda x: F.transform(x["edits"], lambda e: F.struct(e["start"].alias("start"), e["finish"].alias("finish"), F.coalesce(e["put"], F.concat(cut(x["pieces"], e["start"], e["start"] + 1), F.lit("*"))).alias("put"))))
    rows = rows.select("id", "t", F.when(F.size("edits") > 0, initials).otherwise(F.col("edits")).alias("edits"))
    return rows.select(F.col("id").alias("doc_id"), replaced(F.col("t"), F.col("edits"), lambda e, prior: F.when(e["start"] >= prior, e["put"]).otherwise(F.lit(""))).alias("text"))


def op3(docs: DataFrame) -> DataFrame:
    written = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["finish"].cast("string"))), ",")
    found = personal_data(docs)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.concat(F.transform("spans", lambda x: F.struct(x["kind"], x["start"], x["finish"])), F.transform("terms", lambda x: F.struct(x["kind"], x["start"], x["finish"])))
    return found.select(F.col("id").alias("doc_id"), *[count(kind) for kind in KINDS], F.sha2(written("spans"), 256).alias("base_sha256"), written(both).alias("spans"))


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_matches = " UNION ALL ".join(f"SELECT r, {i} AS o, '{k}' AS kind, regexp_extract_all(t, '{x}') AS v, string_split_regex(t, '{x}') AS g FROM d" for i, (k, x) in enumerate(_SQL_PATTERNS.items()))
_placed = "sum(length(g)) OVER w + coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM d),
m AS ({_matches}),
x AS (SELECT r, o, kind, unnest(v) AS v, unnest(g[1:len(v)]) AS g, generate_subscripts(v, 1) AS k FROM m WHERE len(v) > 0),
p AS (SELECT r, o, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS dg, ({_placed})::BIGINT AS s FROM x WINDOW w AS (PARTITION BY r, o ORDER BY k)),
b AS (SELECT r, o, kind, lower(v) AS entity, dg, s, s + length(v) AS e FROM p WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN regexp_matches(v, '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])\.){{3}}0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$')
  WHEN 'card' THEN length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(list_transform(range(length(dg)), lambda i: substr(dg, (length(dg) - i)::BIGINT, 1)::INT * (i % 2 + 1)), lambda y: CASE WHEN y > 9 THEN y - 9 ELSE y END)) % 10 = 0
  ELSE length(dg) BETWEEN 8 AND 15 END),
mp AS (SELECT r, s, e, row_number() OVER w AS k, coalesce(max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM b WINDOW w AS (PARTITION BY r ORDER BY s, e)),
mk AS (SELECT r, string_agg(CASE WHEN s > prior THEN substr(t, (prior + 1)::BIGINT, (s - prior)::BIGINT) ELSE '' END || repeat(' ', greatest(0, e - greatest(s, prior))::BIGINT), '' ORDER BY k) || any_value(substr(t, (far + 1)::BIGINT)) AS rest, any_value(length(t)) AS size
  FROM mp JOIN d USING (r) JOIN (SELECT r, max(e) AS far FROM b GROUP BY r) USING (r) GROUP BY r),
cl AS (SELECT r, kind, s, e, rest, size, entity, CASE kind WHEN 'email' THEN '@' || split_part(entity, '@', 2) WHEN 'ip' THEN split_part(entity, '.', 1) || '.' || split_part(entity, '.', 2) || '.*' WHEN 'card' THEN substr(dg, 1, 6) || '*' ELSE '+' || substr(dg, 1, 4) || '*' END AS class FROM b JOIN mk USING (r)),
en AS (SELECT r, kind, s, e, rest, size, unnest([entity, class]) AS entity FROM cl),
c AS (SELECT r, kind, entity, substr(rest, (greatest(s - {CONTEXT}, 0) + 1)::BIGINT, (s - greatest(s - {CONTEXT}, 0))::BIGINT) AS l, substr(rest, (e + 1)::BIGINT, {CONTEXT}) AS g, s > {CONTEXT} AS lc, e + {CONTEXT} < size AS gc FROM en),
t AS (SELECT DISTINCT r, kind, entity, lower(unnest(regexp_extract_all(CASE WHEN lc THEN regexp_replace(l, '^\p{{L}}+', '') ELSE l END || ' ' || CASE WHEN gc THEN regexp_replace(g, '\p{{L}}+$', '') ELSE g END, '{TERM}'))) AS term FROM c),
nb AS (SELECT kind, entity, term, count(*) AS nboth FROM t GROUP BY ALL),
nr AS (SELECT kind, term, count(DISTINCT r) AS nnear FROM t GROUP BY ALL),
ne AS (SELECT kind, entity, count(DISTINCT r) AS ne FROM en GROUP BY ALL),
nk AS (SELECT kind, count(DISTINCT r)::DOUBLE AS nk FROM b GROUP BY ALL),
nt AS (SELECT term, count(*) AS nt FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{TERM}'))) AS term FROM d) GROUP BY term),
al AS (SELECT * REPLACE (greatest(nt, nboth) AS nt) FROM nb JOIN ne USING (kind, entity) JOIN nr USING (kind, term) JOIN nk USING (kind) JOIN nt USING (term), n),
di AS (SELECT kind, entity, term FROM al WHERE ne < n AND nboth > ne * nt / n AND round(ne * nt / n - nboth + nboth * ln(nboth / (ne * nt / n)), 6) >= {-math.log(CHANCE)!r}
  AND round(least(log2(nboth * n / (ne * nt)) / log2(n / ne), CASE WHEN nk > ne THEN log2(nboth * nk / (ne * nnear)) / log2(nk / ne) END), 6) >= {GENERALISE}),
ms AS (SELECT DISTINCT r, term FROM t SEMI JOIN di ON t.kind = di.kind AND t.entity = di.entity AND t.term = di.term),
wi AS (SELECT r, regexp_extract_all(rest, '{TERM}') AS vs, string_split_regex(rest, '{TERM}') AS gs FROM mk WHERE r IN (SELECT r FROM ms)),
wx AS (SELECT r, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g, generate_subscripts(vs, 1) AS k FROM wi WHERE len(vs) > 0),
wp AS (SELECT r, lower(v) AS term, ({_placed})::BIGINT AS s, length(v) AS n FROM wx WINDOW w AS (PARTITION BY r ORDER BY k)),
ts AS (SELECT r, s, s + n AS e FROM wp SEMI JOIN ms ON wp.r = ms.r AND wp.term = ms.term),
u AS (SELECT r, o, kind || ':' || s || ':' || e AS span, s, e FROM b UNION ALL SELECT r, 4, 'term:' || s || ':' || e, s, e FROM ts),
q AS (SELECT r, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip, count(*) FILTER (o = 2) AS n_card, count(*) FILTER (o = 3) AS n_phone, string_agg(span, ',' ORDER BY o, s) FILTER (o < 4) AS base, string_agg(span, ',' ORDER BY o, s) AS spans FROM u GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN q USING (r)
"""
