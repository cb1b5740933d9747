"""MinHash near-dedup by an LSH forest, with an exact join where the forest leaves a region in pieces.

A text is the set of its distinct shingles of ``words`` words, A-Z lower-cased. Equal sets are one class. A class has a
signature of TREES * BASE minima, of which one byte each is kept. Every tree is a sorted order of all classes by LEVELS
minima, beginning with the tree's own. Neighbours in an order have the longest common prefixes; classes that share BASE minima
or more form a region. The depth adapts to the region: where more than CROWDED classes share a prefix, neighbours must
share a longer one. Over all orders together, each class follows the PICKS neighbours of the greatest common depth, and that of
the smallest id; pairs that pass the bounds on set sizes and signatures are confirmed on the full sets and grown into components. In a second
round each component does the same with neighbours in other components.

Regions that still hold several components then go through an exact join on the rare shingles of their sets, which leaves
no similar pair of them out. Its pairs can still grow with the square of a large group whose similarities lie around the threshold. Two classes of similarity 0.8 share
no region with probability (1 - 0.8**5)**40, about 1e-7; that chance is the only inexactness.

Scale: the orders are dealt by range with the id as the last key, so a group of a third of all classes is spread evenly; a task
holds 24 bytes a row of its part of an order. Two rows a partition are collected to compare neighbours across partitions.

Edge cases: null or empty text has an empty set and is linked with nothing; a text of fewer words than a shingle is one
shingle; rows that share an id are one document with all the rows' links; null ids are linked with nothing and have a
null component; an empty table gives an empty result; other columns pass through, those named like the added ones are
replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, add_columns, mixed, released, small, tidied, written

TREES, BASE, LEVELS, CROWDED, PICKS = 40, 5, 8, 64, 4
HASHES = TREES * BASE


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    high = (seeds >> np.uint64(32)).astype(np.uint32)
    return high[:HASHES, None] | np.uint32(1), high[HASHES:, None]


class Shingles:
    """Per task: texts to sorted arrays of 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words, self.hashes = words, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        h = self.hashes.of((text or "").encode().lower())
        if not len(h):
            return h
        n = min(self.words, len(h))
        x = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One byte of the minimum of a set under each permutation: equal minima have equal bytes, others by chance of 1 in 256."""
    a, b = permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.empty(HASHES, np.uint32)
    step = max(1, 200_000 // x.shape[1])
    for k in range(0, HASHES, step):
        out[k : k + step] = ((x ^ b[k : k + step]) * a[k : k + step]).min(1)
    return out.astype(np.uint8)


def sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, n, s1, s2, sig): the size, a 128-bit hash and the signature of each row's set; sig is null for empty sets."""

    def make():
        import xxhash

        own = Shingles(words)

        def one(text):
            x = own.of(text)
            a, b = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
            return len(x), int(a), int(b), signature(x).tobytes() if len(x) else None

        return lambda col: zip(*map(one, col.to_pylist()), strict=True) if len(col) else [[]] * 4

    df = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return add_columns(df, ["text"], [("n", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()), ("sig", T.BinaryType())], make).drop("text")


def orders(classes: DataFrame) -> DataFrame:
    """(tree, key, id) of each class in each tree: the key is LEVELS bytes of the signature from the tree's first minimum on, as a number of the same order."""
    places = (np.arange(TREES)[:, None] * BASE + np.arange(LEVELS)) % HASHES

    def run(batches):
        for b in batches:
            if len(b):
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), HASHES)
                key = np.ascontiguousarray(sig[:, places]).view(">i8").astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(b))), pa.array(key), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], names=["tree", "key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "tree int, key long, id long")


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes two arrays of keys share."""
    d = np.asarray(x ^ y).view(np.uint64)
    return sum((d < np.uint64(1 << 8 * k)).astype(np.int8) for k in range(LEVELS))


def region_of(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash of the tree and the first BASE minima."""
    return mixed(((key >> np.int64(8 * (LEVELS - BASE))) * np.int64(TREES) + tree).view(np.uint64)).view(np.int64)


def needed_depth(near: np.ndarray) -> np.ndarray:
    """Per gap between rows of an order, the prefix that neighbours must share: one more than any that over CROWDED rows around it share."""
    depth = np.full(len(near), BASE, np.int8)
    if len(near) >= CROWDED:
        run = np.lib.stride_tricks.sliding_window_view(near, CROWDED).min(1)  # what CROWDED + 1 rows share
        run = np.concatenate((np.zeros(CROWDED - 1, np.int8), run, np.zeros(CROWDED - 1, np.int8)))
        depth = np.clip(np.lib.stride_tricks.sliding_window_view(run, CROWDED).max(1) + 1, BASE, LEVELS)
    return depth


def forest_rows(classes: DataFrame) -> DataFrame:
    """(region, id, prev, lcp) of all classes in regions of several: prev is the neighbour before it, null if their common prefix is too short.

    A written table, with edge = 0; rows of edge 1 and 2 are the partitions' first and last ones.
    """
    schema = "edge int, part int, tree int, region long, id long, prev long, lcp int"

    def rows(edge, part, tree, region, ids, prev, keep, lcp):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(tree), pa.array(region), pa.array(ids), pa.array(prev, mask=~keep), pa.array(lcp.astype(np.int32))], names=[x.split(" ")[0] for x in schema.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), [b for b in batches if len(b)]
        if not own:
            return
        tree, key, ids = (np.concatenate([b.column(c).to_numpy() for b in own]) for c in range(3))
        near = np.where(tree[1:] == tree[:-1], common_prefix(key[1:], key[:-1]), 0).astype(np.int8)
        keep = np.concatenate(([False], (near >= needed_depth(near)) & (ids[1:] != ids[:-1])))
        near = np.concatenate(([0], near, [0]))
        inside = np.flatnonzero((near[:-1] >= BASE) | (near[1:] >= BASE))
        prev = np.concatenate((ids[:1], ids[:-1]))
        for k in range(0, len(inside), 100_000):
            at = inside[k : k + 100_000]
            yield rows(0, part, tree[at], region_of(tree[at], key[at]), ids[at], prev[at], keep[at], near[at])
        for edge, at in ((1, slice(0, 1)), (2, slice(len(ids) - 1, len(ids)))):
            yield rows(edge, part, tree[at], key[at], ids[at], ids[at], np.zeros(1, bool), near[at])

    sorted_ = orders(classes).repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = written(sorted_.mapInArrow(run, schema), "forest")
    ends = sorted(found.where("edge > 0").select("part", "edge", "tree", "region", "id").collect())
    more = []
    for (_, _, tree, x, a), (_, _, same, y, b) in zip(ends[1::2], ends[2::2], strict=False):
        lcp = int(common_prefix(np.array([x]), np.array([y]))[0])
        if tree == same and lcp >= BASE:
            region = int(region_of(np.array([tree]), np.array([x]))[0])
            more += [(region, a, None, 0), (region, b, a if a != b else None, lcp)]
    out = found.where("edge = 0").select("region", "id", "prev", "lcp")
    return out.union(classes.sparkSession.createDataFrame(more, out.schema)) if more else out


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that may reach the similarity, by set size and by signature bytes (6.5 standard deviations below); the exact join does not rely on it."""
    own = classes.select("id", "n", "sig")
    both = pairs.join(own.toDF("a", "n_a", "sig_a"), "a").join(own.toDF("b", "n_b", "sig_b"), "b")
    both = both.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))
    p = percent / 100
    least = HASHES * p - 6.5 * (HASHES * p * (1 - p)) ** 0.5

    def run(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), HASHES) for c in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, as a written table."""
    need = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "need")
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = written(own.join(small(need, 500_000), "id", "left_semi"), "texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        shingles = Shingles(words)
        last, known = None, None
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if y != last:  # rows of one b follow each other
                    last, known = y, shingles.of(y)
                s = shingles.of(x)
                both = len(s) + len(known) - len(np.union1d(s, known))
                keep.append(100 * both >= percent * (len(s) + len(known) - both) and both > 0)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = written(both.mapInArrow(run, "a long, b long").distinct(), "links")
    released(texts, need)
    return links


def prefix_pairs(open_: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """All pairs (a, b) of the classes in open_ (id, component) of different components that can reach the similarity.

    Shingles are ordered from rare to frequent. Two similar sets of n <= m shingles share at least percent / (100 + percent) of n + m,
    so the first that they share lies among the first n - 2 * percent / (100 + percent) * n + 1 of the smaller set and the first
    m - percent % of m + 1 of the larger one, and after it enough must be left in both. Shingles that many sets share come last and often lie
    after the smaller set's bound; those that do not make as many pairs as sets that share them.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    own = own.join(small(open_, 500_000), "id").select("id", "component", "text")

    def run(batches):
        shingles = Shingles(words)
        for b in batches:
            sets = [shingles.of(t) for t in b.column(2).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            rows = np.repeat(np.arange(len(sets)), n)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(n[rows]), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "component", "n", "s"])

    rows = written(own.mapInArrow(run, "id long, component long, n long, s long").distinct(), "shingles")
    common = written(rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "common")
    by = Window.partitionBy("id", "n")
    # Shingles of one set only come first in the order and need no rows.
    ranked = rows.join(common, "s").withColumn("p", F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("df", "s")) - 1)
    least = lambda n, share: F.floor((F.col(n) * share[0] + share[1] - 1) / share[1])
    of_smaller, of_larger = (2 * percent, 100 + percent), (percent, 100)
    prefixes = written(ranked.where(F.col("p") <= F.col("n") - least("n", of_larger)).select("s", "id", "component", "n", "p"), "prefixes")
    released(rows, common)
    a, b = prefixes.where(F.col("p") <= F.col("n") - least("n", of_smaller)).toDF("s", "a", "c_a", "n_a", "p_a"), prefixes.toDF("s", "b", "c_b", "n_b", "p_b")
    near = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    met = a.join(b, (a["s"] == b["s"]) & (F.col("c_a") != F.col("c_b")) & sizes & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def settled(edge: DataFrame) -> bool:
    """Whether the edges (u, v) are stars already: every u has one v, and no v is a u."""
    ends = edge.select(F.col("u").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("met")).union(edge.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out > 1 OR out = 1 AND met = 1").limit(1).count()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of the links (a, b) reaches, by alternating large and small stars."""
    edge = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if settled(edge):
            break
        around = edge.union(edge.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        old, edge = edge, written(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct(), "small")
        released(old, large)
    else:
        raise RuntimeError("the components did not settle")
    own = edge.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return written(own.union(edge.select("v", "v").distinct()), "components")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, component) with components joined by more links (a, b): only the components that these touch are worked on."""
    own = groups.select("id", "component")
    ends = links.join(own.toDF("a", "c"), "a", "left").join(own.toDF("b", "d"), "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    more = components(written(ends.where("a <> b").distinct(), "ends")).toDF("__id", "__to")
    ids = own.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("component").alias("component"))
    return written(ids.join(more, F.col("component") == F.col("__id"), "left").select("id", F.coalesce("__to", "component").alias("component")), "components")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, component) with components joined by more links (a, b): only the components that these touch are worked on."""
    own = groups.select("id", "component")
    ends = links.join(own.toDF("a", "c"), "a", "left").join(own.toDF("b", "d"), "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    more = components(written(ends.where("a <> b").distinct(), "ends")).toDF("__id", "__to")
    ids = own.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("component").alias("component"))
    return written(ids.join(more, F.col("component") == F.col("__id"), "left").select("id", F.coalesce("__to", "component").alias("component")), "components")


def pairs_of(df: DataFrame, other: str) -> DataFrame:
    """Distinct (a, b), a < b, of the columns id and other."""
    return df.where(F.col("id") != F.col(other)).select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()


def followed(neighbours: DataFrame, one: str, two: str) -> DataFrame:
    """Of neighbours (a, b, depth), those that either side follows, sides being told by the columns one and two: PICKS of the greatest depth and that of the smallest other side."""
    sides = neighbours.select(F.col(one).alias("k"), F.col(two).alias("o"), "a", "b", "depth").union(neighbours.select(two, one, "a", "b", "depth"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("depth"), F.xxhash64("a", "b")))
    least = sides.groupBy("k").agg(F.min_by("a", "o").alias("a"), F.min_by("b", "o").alias("b"))
    return sides.withColumn("r", rank).where(F.col("r") <= PICKS).select("a", "b").union(least.select(F.least("a", "b"), F.greatest("a", "b"))).where("a < b").distinct()


def grown(found: DataFrame, classes: DataFrame, known: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(components, pairs tested on full sets) from the forest's neighbours alone; known: links (a, b) there are already."""
    how, spark = (docs, doc_id, text, words, percent), classes.sparkSession
    order = found.where("prev <> id").select(F.least("id", "prev").alias("a"), F.greatest("id", "prev").alias("b"), "lcp")
    neighbours = written(order.groupBy("a", "b").agg(F.sum("lcp").alias("depth")), "neighbours")
    first = written(alike(followed(neighbours, "a", "b"), classes, percent), "near")
    links = confirmed(first, *how)
    tidied(spark)
    groups = components(links.union(known))
    # Components follow neighbours not compared yet; what they miss is left to the exact join.
    own = groups.select("id", "component")
    apart = neighbours.join(first, ["a", "b"], "left_anti").join(own.toDF("a", "c"), "a", "left").join(own.toDF("b", "d"), "b", "left").withColumns({"c": F.coalesce("c", "a"), "d": F.coalesce("d", "b")})
    apart = written(apart.where("c <> d").select("a", "b", "depth", "c", "d"), "apart")
    second = written(alike(followed(apart, "c", "d"), classes, percent), "near")
    more = confirmed(second, *how)
    released(neighbours, apart)
    tidied(spark)
    return (joined(groups, more) if more.limit(1).count() else groups), first.union(second)


def prepared(docs: DataFrame, doc_id: str, text: str, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: every row's set, the classes of equal sets, and links (a, b) between the classes of rows that share an id."""
    every = written(sets(docs, doc_id, text, words), "sets")
    full = every.where("n > 0 AND id IS NOT NULL")
    classes = written(full.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig")), "classes")
    several = full.groupBy("id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("id")
    shared = full.join(small(written(several, "several")), "id", "left_semi").select(F.col("id").alias("a"), "s1", "s2").distinct()
    return every, classes, written(shared.join(classes.select("s1", "s2", F.col("id").alias("b")), ["s1", "s2"]).select("a", "b"), "shared")


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of docs."""
    how = (docs, doc_id, text, words, percent)
    every, classes, shared = prepared(docs, doc_id, text, words)
    tidied(docs.sparkSession)
    found = forest_rows(classes)
    tidied(docs.sparkSession)
    groups, tested = grown(found, classes, shared, *how)
    # Regions that hold several components: the exact way for what the forest has not linked.
    placed = written(found.select("region", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    split = placed.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("region")
    open_ = written(placed.join(small(written(split, "split")), "region", "left_semi").select("id", "component").distinct(), "open")
    released(found, placed)
    rest = prefix_pairs(open_, *how)
    more = confirmed(written(rest.join(tested, ["a", "b"], "left_anti"), "rest"), *how)
    tidied(docs.sparkSession)
    if more.limit(1).count():
        groups = joined(groups, more)
    own = classes.select("s1", "s2", F.col("id").alias("__first")).join(groups, F.col("__first") == groups["id"], "left").select("s1", "s2", F.coalesce("component", "__first").alias("component"))
    rows = every.select("id", "n", "s1", "s2").join(written(own, "own"), ["s1", "s2"], "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its group; null ids stay."""
    gone = written(linked(docs, doc_id, text, words, percent).where("NOT kept").select("id").distinct(), "gone")
    return docs.join(small(gone), docs[doc_id] == gone["id"], "left_anti")
