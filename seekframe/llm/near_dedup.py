"""MinHash near-dedup (8): a chosen-path set similarity join, its links confirmed on full sets.

1. A text is its set of distinct word shingles (64-bit hashes), with `TOKENS` minwise tokens. Rows with equal sets are
   one class; only the class's least document goes on, so copies cost one row each and are never paired.
2. `TREES` independent trees. A tree branches all documents by one minwise token, another in each tree. Nodes with more
   than `TASK` documents are branched on by Spark, level by level, each document into `BRANCHES` children by further
   tokens: a pair of similarity s that shares a node shares one of its children with chance 1 - (1 - s)**BRANCHES, and
   with two children the chance of sharing a node at any level does not fall under 0.9375 of the first level's for
   s = 0.8. TREES is taken from that and the `MISSES` aimed at. What is still larger at the last level is dealt into
   blocks, and every block is compared with every other.
3. In each node all documents are compared on 8 bits of each token. Only a spanning forest of the pairs that may be
   alike is emitted, likeliest pairs first, ties in an order of the tree's own: under one pair a document.
4. Each document's likeliest pair is confirmed on full sets, built anew from the texts of both sides; components are
   found by hooking and pointer jumping, and the forests' other pairs between different components are confirmed next.
5. The nodes are searched again for documents that may be like one of another component. These are joined exactly
   within their family (what the forests' pairs connect, confirmed or not): documents outside the family's largest
   component meet all of the family, block by block, on full sets, and a spanning forest of the links is emitted.
   Nothing is capped; what is missed is missed by the trees' chances and by the estimate of step 3 alone.

A null text and a text without words have the empty set and are linked with nothing. A very long text is one set, whole.
Fewer words than a shingle are one shingle. A null id sorts first. Rows that repeat an id, with equal or other texts,
are one node of the graph. Ties between equally likely pairs do not change the components. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_back, id_key, lookup, prepare, saved, text_of

TOKENS, BRANCHES, DEPTH, TASK = 64, 2, 8, 4000
#: Chance, by the trees, to miss a pair at the threshold of 0.8; 0.9375 is the fixed point of q = 1 - (1 - 0.8 q)**2.
MISSES = 1e-7
TREES = math.ceil(math.log(MISSES) / math.log(1 - 0.8 * 0.9375))
#: Share of equal tokens from which a pair may be alike: 0.8 less 5 standard deviations.
MAYBE = 0.55
#: Documents of a family's block, and the length of their texts.
BLOCK, BLOCK_CHARS = 500, 8_000_000
PERCENT = 80
#: Tables of ids are broadcast up to so many rows, after a count; beyond, both sides are shuffled.
ID_ROWS = 1_000_000


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = _constants(11, TOKENS)
#: By tree: the token of the first level, then BRANCHES of each further one. No two trees have one first token.
ORDERS = np.stack([np.roll(np.random.default_rng(100).permutation(TOKENS), -5 * t) for t in range(TREES)])


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word k-shingles; A-Z are lower-cased; words are split at ASCII blanks."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: ASCII only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    kept: dict[bytes, int] = {}
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter((kept[w] if w in kept else kept.setdefault(w, one(w)) for w in words), np.uint64, n)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for j in range(size):
            out = mixed(out + h[j : n - size + 1 + j])
    return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """TOKENS 32-bit minima of a set that isn't empty."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            values = shingles[None, a : a + 2048] * MULTIPLIERS[:, None]
            values ^= values >> np.uint64(29)
            values *= np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum(least, values.min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def sets(docs: DataFrame, k: int) -> DataFrame:
    """key, n_shingles, c1, c2 (128-bit hash of the set), tokens (binary; null for the empty set) of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            n, c1, c2, tokens = [], [], [], []
            for text in batch["t"]:
                own = shingle_set(text, k)
                n.append(len(own))
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                c1.append((digest >> 64) - 2**63)
                c2.append((digest & (2**64 - 1)) - 2**63)
                tokens.append(minwise(own).tobytes() if len(own) else None)
            yield pd.DataFrame({"key": batch["key"], "n_shingles": n, "c1": c1, "c2": c2, "tokens": tokens})

    return docs.select(id_key().alias("key"), text_of().alias("t")).mapInPandas(run, "key long, n_shingles long, c1 long, c2 long, tokens binary")


def first_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every document in its first-level node of every tree: tree, node, key, signs (8 bits of each token)."""
    for batch in batches:
        if not len(batch):
            continue
        tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(-1, TOKENS)
        signs = [x.tobytes() for x in tokens.astype(np.uint8)]
        for tree in range(TREES):
            node = mixed(tokens[:, ORDERS[tree, 0]].astype(np.uint64) + np.uint64(tree << 32)).view(np.int64)
            yield pd.DataFrame({"tree": np.full(len(batch), tree, np.int32), "node": node, "key": batch["key"], "signs": signs})


def equal_tokens(signs: np.ndarray) -> np.ndarray:
    """For all pairs of rows the number of equal bytes; 0 on the diagonal and where it is under MAYBE."""
    words, m = np.ascontiguousarray(signs).view(np.uint64), len(signs)
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    equal = np.empty((m, m), np.uint8)
    for a in range(0, m, 32):
        x = words[a : a + 32, None, :] ^ words[None, a:, :]
        zero = ~(((x & low) + low) | x | low)  # the high bit of each byte that is zero
        equal[a : a + 32, a:] = np.bitwise_count(zero).sum(2, dtype=np.uint8)
        equal[a:, a : a + 32] = equal[a : a + 32, a:].T
    np.fill_diagonal(equal, 0)
    equal[equal < MAYBE * TOKENS] = 0
    return equal


def forest(keys: np.ndarray, signs: np.ndarray, labels: np.ndarray, tree: int, level: int, out: list) -> None:
    """A spanning forest of a node's pairs that may be alike, likeliest first: each round joins components by their best pair."""
    order = np.argsort(mixed(keys.astype(np.uint64) + np.uint64(tree * 104729)))
    keys, signs = keys[order], signs[order]
    equal = equal_tokens(signs)
    some = equal.any(1)
    keys, equal = keys[some], equal[some][:, some]
    m, part = len(keys), np.arange(len(keys))
    while m:
        free = np.where(part[:, None] != part[None, :], equal, 0)
        to = free.argmax(1)
        value = free[np.arange(m), to]
        best = np.lexsort((-value.astype(np.int64), part))
        best = best[np.concatenate(([True], part[best][1:] != part[best][:-1]))]
        best = best[value[best] > 0]
        if not len(best):
            break
        up = np.arange(m)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        taken = []
        for i in best.tolist():
            a, b = root(int(part[i])), root(int(part[to[i]]))
            if a != b:
                up[a] = b
                taken.append(i)
        part = np.array([root(x) for x in range(m)])[part]
        out.append(np.stack((keys[taken], keys[to[taken]], value[taken].astype(np.int64))))


def unresolved(keys: np.ndarray, signs: np.ndarray, labels: np.ndarray, tree: int, level: int, out: list) -> None:
    """Each document that may be like one of another label, paired with itself."""
    if len(np.unique(labels)) < 2:
        return
    equal = equal_tokens(signs)
    for a in range(0, len(keys), 256):
        equal[a : a + 256][labels[a : a + 256, None] == labels[None, :]] = 0
    own = keys[equal.any(1)]
    out.append(np.stack((own, own, np.zeros(len(own), np.int64))))


def node_pairs(search):
    """For rows (tree, node, level, key, signs, label) sorted by tree and node -> a, b (a < b), equal of each node's search."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            out: list[np.ndarray] = [np.empty((3, 0), np.int64)]
            node, key, label = (rows[c].to_numpy(np.int64) for c in ("node", "key", "label"))
            tree, level = rows["tree"].to_numpy(np.int32), rows["level"].to_numpy(np.int32)
            cuts = np.concatenate(([0], np.flatnonzero((node[1:] != node[:-1]) | (tree[1:] != tree[:-1])) + 1, [len(rows)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    signs = np.frombuffer(b"".join(rows["signs"].iloc[a:b]), np.uint8).reshape(-1, TOKENS)
                    search(key[a:b], signs, label[a:b], int(tree[a]), int(level[a]), out)
            x, y, equal = np.concatenate(out, axis=1)
            return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "equal": equal}).drop_duplicates()

        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*held, batch], ignore_index=True)
            last = (rows["node"] == rows["node"].iloc[-1]) & (rows["tree"] == rows["tree"].iloc[-1])
            held = [rows[last]]
            yield found(rows[~last])
        if held:
            yield found(held[0])

    return run


def children(position: int) -> Column:
    """The bytes of a document's tokens by which its tree branches it, from that position of the order on."""
    at = F.element_at(F.array(*[F.array(*[F.lit(int(x) + 1) for x in ORDERS[t, position : position + BRANCHES]]) for t in range(TREES)]), F.col("tree") + 1)
    return F.explode(F.transform(at, lambda x: F.struct(x.alias("at"), F.substring(F.col("signs"), x, F.lit(1)).alias("sign"))))


def tree_nodes(classes: DataFrame) -> DataFrame:
    """(tree, node, level, key, signs): each class representative (key, tokens) in its nodes of each tree, at most about TASK to a node."""
    rows = classes.mapInPandas(first_nodes, "tree int, node long, key long, signs binary").withColumn("level", F.lit(1))
    rows = saved(rows, "nodes")
    done, level = [], 1
    while True:
        large = saved(rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > TASK), "large")
        if large.isEmpty():
            done.append(rows)
            break
        small = lookup(large)
        done.append(rows.join(small, ["tree", "node"], "left_anti"))
        rows = rows.join(small, ["tree", "node"])
        if level == DEPTH:
            # alike in many tokens so far: blocks of half a task, in every pair of them
            n = F.ceil(2 * F.col("held") / TASK).cast("int")
            own = F.pmod(F.xxhash64("tree", "key"), n).cast("int")
            rows = rows.withColumns({"own": own, "n": n}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            done.append(rows.filter("n = 1 OR own <> other").withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).drop("held", "own", "n", "other"))
            break
        rows = rows.withColumn("c", children(1 + BRANCHES * (level - 1))).withColumn("node", F.xxhash64("node", "c.at", "c.sign")).drop("held", "c")
        level += 1
        rows = saved(rows.withColumn("level", F.lit(level)), "nodes")
    every = done[0].select("tree", "node", "level", "key", "signs")
    for x in done[1:]:
        every = every.unionByName(x.select("tree", "node", "level", "key", "signs"))
    return every


def candidate_pairs(nodes: DataFrame, search) -> DataFrame:
    """(a, b, equal), a < b, found by search in the nodes (tree_nodes with label)."""
    pairs = nodes.repartition("tree", "node").sortWithinPartitions("tree", "node", "key").mapInPandas(node_pairs(search), "a long, b long, equal long")
    return pairs.groupBy("a", "b").agg(F.max("equal").alias("equal"))


def confirm(k: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"].tolist(), batch["ta"], batch["tb"]):
                if a != last:
                    last, own = a, shingle_set(ta, k)
                other = shingle_set(tb, k)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of written pairs (a, b) those whose full sets are alike; texts: (key, t), one row a class representative.

    The ids of the pairs go to the texts of b while their number is small; those texts then meet the texts of a.
    """
    right = texts.select(F.col("key").alias("b"), F.col("t").alias("tb")).join(lookup(pairs.select("a", "b"), ID_ROWS), "b")
    both = right.join(texts.select(F.col("key").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInPandas(confirm(k, percent), "a long, b long")


def jumped(pointers: DataFrame) -> DataFrame:
    """(key, up), up < key -> (key, up) with up the end of the chain."""
    while True:
        above = pointers.select(F.col("key").alias("up"), F.col("up").alias("next"))
        pointers = saved(pointers.join(above, "up", "left").select("key", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "pointers")
        if pointers.filter("moved").isEmpty():
            return pointers.drop("moved")
        pointers = pointers.drop("moved")


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with the ids in column replaced by their labels (key, up) where they have one."""
    found = labels.select(F.col("key").alias(column), F.col("up").alias("_up"))
    return rows.join(found, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(key, up): for each document that isn't the least of its component, the least. links: (a, b); labels: known ones."""
    while True:
        if labels is not None:
            links = labelled(labelled(links, labels, "a"), labels, "b").filter("a <> b")
        links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels if labels is not None else links.select(F.col("b").alias("key"), F.col("a").alias("up"))
        # every id hooks to its least neighbour below it, then to the end of that chain
        hooks = jumped(saved(links.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("up")), "hooks"))
        labels = hooks if labels is None else saved(labelled(labels, hooks, "up").unionByName(hooks.join(labels.select("key"), "key", "left_anti")), "labels")


def links_between(own: list[np.ndarray], own_keys: np.ndarray, other: list[np.ndarray], other_keys: np.ndarray, up: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets. up: labels of the keys, which are joined on the way."""

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    held = np.array([len(x) for x in other])
    shingles, docs = np.concatenate(other), np.repeat(np.arange(len(other)), held)
    order = np.argsort(shingles, kind="stable")
    docs = docs[order]
    distinct, starts = np.unique(shingles[order], return_index=True)
    ends = np.append(starts[1:], len(docs))
    roots = np.array([root(k) for k in other_keys.tolist()])
    out = []
    for x, key in zip(own, own_keys.tolist()):
        if not len(x) or (roots == root(key)).all():
            continue
        at = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
        at = at[distinct[at] == x]
        n = ends[at] - starts[at]
        places = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else at
        both = np.bincount(docs[places], minlength=len(other))
        for y in np.flatnonzero(100 * both >= percent * (len(x) + held - both)).tolist():
            a, b = root(key), root(int(other_keys[y]))
            if a != b and both[y]:
                up[max(a, b)] = min(a, b)
                roots[roots == max(a, b)] = min(a, b)
                out.append((key, int(other_keys[y])))
    return out


def family_links(k: int, percent: int):
    """Rows (family, x, y, side, key, label, t) sorted by family, x, y -> the links (a, b) of side 0's documents with side 1's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, sides, up = None, ([], []), {}

        def found() -> pd.DataFrame:
            own, other = ([shingle_set(t, k) for _, t in side] for side in sides)
            keys = [np.array([x for x, _ in side], np.int64) for side in sides]
            links = links_between(own, keys[0], other, keys[1], up, percent) if own and other else []
            return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

        for batch in batches:
            for family, x, y, side, key, label, text in batch[["family", "x", "y", "side", "key", "label", "t"]].itertuples(index=False, name=None):
                if task != (family, x, y):
                    if task is not None:
                        yield found()
                    task, sides, up = (family, x, y), ([], []), {}
                sides[side].append((key, text))
                up[key] = up.setdefault(label, label) if key != label else label
        if task is not None:
            yield found()

    return run


def joined_families(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of rows (family, key, label, t) of one family and different labels: a spanning forest of each task's.

    The documents outside of a family's most frequent label meet all of the family, in blocks of at most about BLOCK.
    """
    labels = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")).groupBy("family")
    blocks = lambda n, chars: F.ceil(F.greatest(n / BLOCK, chars / BLOCK_CHARS, F.lit(1))).cast("int")
    labels = labels.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max(F.struct("n", "label", "chars")).alias("most"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).filter("most.n < n")
    labels = saved(labels.select("family", "main", blocks(F.col("n") - F.col("most.n"), F.col("chars") - F.col("most.chars")).alias("xs"), blocks(F.col("n"), F.col("chars")).alias("ys")), "families")
    rows = rows.join(lookup(labels), "family")
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("family", "x", "y", "side", "key", "label", "t")
    one = rows.filter("label <> main").withColumns({"x": own("xs"), "side": F.lit(0)}).withColumn("y", every("ys")).select(*columns)
    other = rows.withColumns({"y": own("ys"), "side": F.lit(1)}).withColumn("x", every("xs")).select(*columns)
    return one.unionByName(other).repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "side", "key").mapInPandas(family_links(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component (a key)."""
    found = saved(sets(docs, k), "sets")
    members = found.filter("n_shingles > 0")
    classes = saved(members.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.min_by("tokens", "key").alias("tokens")), "classes")
    nodes = tree_nodes(classes.select(F.col("rep").alias("key"), "tokens"))
    pairs = saved(candidate_pairs(nodes.withColumn("label", F.col("key")), forest), "pairs")
    involved = saved(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "involved")
    texts = saved(docs.select(id_key().alias("key"), text_of().alias("t")).join(lookup(involved, ID_ROWS), "key", "left_semi"), "texts")
    best = saved(pairs.groupBy("b").agg(F.max_by("a", F.struct("equal", -F.col("a"))).alias("a")), "best")
    links = saved(confirmed(best, texts, k, percent), "confirmed")
    labels = components(links)
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = labelled(labelled(rest.withColumns({"x": F.col("a"), "y": F.col("b")}), labels, "a"), labels, "b").filter("a <> b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(confirmed(saved(rest, "rest"), texts, k, percent), labels)
    # a document without a pair in any forest has none in any node, as those are now
    marked = saved(labelled(involved.withColumn("label", F.col("key")), labels, "label"), "marked")
    again = saved(candidate_pairs(nodes.join(lookup(marked, ID_ROWS), "key"), unresolved).select(F.col("a").alias("key")).distinct(), "again")
    if not again.isEmpty():
        families = components(pairs.select("a", "b")).select("key", F.col("up").alias("family"))
        again = saved(again.join(marked, "key").join(families, "key", "left").withColumn("family", F.coalesce("family", "key")), "unresolved")
        labels = components(joined_families(texts.join(lookup(again, ID_ROWS), "key"), k, percent), labels)
    ups = labelled(classes.select("c1", "c2", F.col("rep").alias("component")), labels, "component")
    return found.join(ups, ["c1", "c2"], "left").select("key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))


def op8(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, 4)
    return out.select(id_back("key").alias("doc_id"), "n_shingles", id_back("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


#: All pairs that share a shingle, exactly; components by reachability.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < 4 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b WHERE 100 * n >= 80 * (len(ga.s) + len(gb.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, doc_id = c AS kept FROM g JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""
