"""Affinities of neighbours: the precision of each point by bisection on the entropy, conditional and joint probabilities."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import knn as neighbours

TOLERANCE, UPDATES, FLOOR = 1e-5, 50, 1e-7
#: Edges of a packed row, so that 10,000 rows, as Spark sends at once, hold 20 MB; rows that are sent back at once.
RUN, BATCH = 128, 1 << 16
#: Edges that are calibrated at once, or a point's, and -ln of a part of the largest weight that no sum in doubles notices.
EDGES, NEGLIGIBLE = 1 << 20, 100.0


def weight_sum(ds: Column, beta: Column) -> Column:
    """The sum of exp(-d * beta), FLOOR if it is exactly 0."""
    s = F.aggregate(ds, F.lit(0.0), lambda a, d: a + F.exp(-d * beta))
    return F.when(s == 0, F.lit(FLOOR)).otherwise(s)


def entropy(ds: Column, beta: Column) -> Column:
    s = weight_sum(ds, beta)
    t = F.aggregate(ds, F.lit(0.0), lambda a, d: a + d * F.exp(-d * beta))
    return F.log(s) + beta * t / s


def is_close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) < tolerance


def beta_search(ds: Column, perplexity: float) -> Column:
    """beta whose entropy is ln(perplexity): doubled or halved until bracketed, then bisected, at most UPDATES times."""
    target = F.lit(math.log(perplexity))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(1.0).alias("beta"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        beta, lo, hi, h = s["beta"], s["lo"], s["hi"], entropy(ds, s["beta"])
        high = h > target
        done = s["done"] | is_close(h, target)
        up = F.when(hi.isNull(), beta * 2).otherwise((beta + hi) / 2)
        down = F.when(lo.isNull(), beta / 2).otherwise((beta + lo) / 2)
        moved = F.struct(F.when(high, up).otherwise(down).alias("beta"), F.when(high, beta).otherwise(lo).alias("lo"), F.when(high, hi).otherwise(beta).alias("hi"), F.lit(False).alias("done"))
        return F.when(done, F.struct(beta.alias("beta"), lo.alias("lo"), hi.alias("hi"), F.lit(True).alias("done"))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(UPDATES)), start, step)["beta"]


def calibrated(knn: DataFrame, perplexity: float) -> DataFrame:
    """(i, edges, beta); a point's edges are its k neighbours, so the array is small. Perplexity should be below k."""
    rows = knn.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("edges"))
    return rows.withColumn("beta", beta_search(F.col("edges.d"), perplexity))


def packed(edges: DataFrame) -> DataFrame:
    """(i, js, ds): runs of at most RUN consecutive edges of a point as one row; js holds the first j and then the steps to the next."""

    def pack(batches):
        for b in batches:
            if not len(b):
                continue
            if b.column(0).null_count or b.column(1).null_count:
                raise ValueError("an edge lacks an id")
            i, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.r_[True, i[1:] != i[:-1]]
            at = np.flatnonzero(first)
            first |= (np.arange(len(i)) - np.repeat(at, np.diff(np.r_[at, len(i)]))) % RUN == 0
            begin = np.flatnonzero(first)
            ends = pa.array(np.r_[begin, len(i)], pa.int32())
            steps = np.where(first, j, np.diff(j, prepend=0))
            yield pa.RecordBatch.from_arrays([pa.array(i[begin]), pa.ListArray.from_arrays(ends, pa.array(steps)), pa.ListArray.from_arrays(ends, b.column(2))], names=["i", "js", "ds"])

    return edges.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("d").cast("double")).mapInArrow(pack, "i long, js array<bigint>, ds array<double>")


def unpacked(runs: DataFrame, value: str) -> DataFrame:
    """The edges (i, j, value) of packed() ones."""

    def unpack(batches):
        for b in batches:
            if len(b):
                js, ds = b.column(1), b.column(2)
                count = js.value_lengths().to_numpy()
                i, j = np.repeat(b.column(0).to_numpy(), count), from_steps(js)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), ds.flatten()], names=["i", "j", value])

    return runs.select("i", "js", "ds").mapInArrow(unpack, f"i long, j long, {value} double")


def from_steps(js: pa.ListArray) -> np.ndarray:
    """The ids of lists that hold a first id and then the steps to the next."""
    count = js.value_lengths().to_numpy()
    total, begin = np.cumsum(js.flatten().to_numpy()), np.cumsum(count) - count
    return total - np.repeat(np.r_[0, total][begin], count)


def weights(d: np.ndarray, begin: np.ndarray, perplexity: float) -> np.ndarray:
    """The conditional probabilities of edges that stand point by point, each point's from begin on; the search is that of beta_search().

    beta never falls below a lo again, so that the search goes on without edges whose weights are too small against the nearest one's to change a sum.
    """
    count, target = np.diff(np.r_[begin, len(d)]), math.log(perplexity)
    beta, lo, hi, done = np.ones(len(begin)), np.full(len(begin), np.nan), np.full(len(begin), np.nan), np.zeros(len(begin), bool)
    known = np.where(np.isnan(d), np.inf, d)
    left, at, size = known, begin, count  # the edges that matter
    nearest = np.minimum.reduceat(known, begin)

    def sums(known: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = known * np.repeat(-beta, count)
        np.exp(w, out=w)
        s = np.add.reduceat(w, begin)
        return w, np.where(s == 0, FLOOR, s)

    with np.errstate(all="ignore"):
        for _ in range(UPDATES):
            w, s = sums(left, at, size)
            w = left * w
            w[np.isnan(w)] = 0.0  # an infinite distance has no weight
            h = np.log(s) + beta * np.add.reduceat(w, at) / s
            done |= np.abs(h - target) < TOLERANCE
            if done.all():
                break
            high = ~(h <= target)
            moved = np.where(high, np.where(np.isnan(hi), beta * 2, (beta + hi) / 2), np.where(np.isnan(lo), beta / 2, (beta + lo) / 2))
            lo, hi = np.where(high & ~done, beta, lo), np.where(high | done, hi, beta)
            beta = np.where(done, beta, moved)
            matter = left <= np.repeat(np.where(done, nearest, np.where(np.isnan(lo), np.inf, nearest + NEGLIGIBLE / lo)), size)
            if np.count_nonzero(matter) < len(left) / 2:
                left, size = left[matter], np.add.reduceat(matter, at, dtype=np.int64)
                at = np.cumsum(size) - size
        w, s = sums(known, begin, count)
        return np.where(np.isnan(d), np.nan, w / np.repeat(s, count))


def starts(i: np.ndarray) -> np.ndarray:
    """Where the edges of each point begin."""
    return np.flatnonzero(np.r_[True, i[1:] != i[:-1]])


def all_affinities(vectors: DataFrame, perplexity: float, metric: str = "sqeuclidean") -> DataFrame:
    """pairwise_affinities() of knn.all_distances(): the task that makes a point's distances calibrates them, so that no table of N * N rows is written or shuffled."""
    held = neighbours.whole(vectors)
    if held is None:
        return pairwise_affinities(neighbours.all_distances(vectors, metric), perplexity)

    def run(i: np.ndarray, j: np.ndarray, d: np.ndarray):
        yield from neighbours.edge_batches(i, j, weights(d, starts(i), perplexity), BATCH, ("i", "j", "p"))

    return held.by_points(run, "i long, j long, p double", metric)


def pairwise_affinities(knn: DataFrame, perplexity: float, together: bool = False) -> DataFrame:
    """(i, j, p): conditional probabilities, which sum to 1 for each i. A point may have any number of edges, as in a distance table.

    together: all edges of a point are known to follow each other in one partition, so that none has to be shuffled.
    """

    def calibrate(i: np.ndarray, j: np.ndarray, d: np.ndarray):
        by = np.lexsort((j, d, i))
        i, j, d = i[by], j[by], d[by]
        p = weights(d, starts(i), perplexity) if len(i) else d
        yield from neighbours.edge_batches(i, j, p, BATCH, ("i", "j", "p"))

    def run_together(batches):
        kept, rows = [], 0
        for b in batches:
            if b.column(0).null_count or b.column(1).null_count:
                raise ValueError("an edge lacks an id")
            kept.append([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)])
            rows += len(b)
            if rows >= EDGES and (kept[0][0][0] != kept[-1][0][-1]):
                i, j, d = (np.concatenate(x) for x in zip(*kept, strict=True))
                last = starts(i)[-1]
                yield from calibrate(i[:last], j[:last], d[:last])
                kept, rows = [[i[last:], j[last:], d[last:]]], len(i) - last
        if rows:
            yield from calibrate(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    if together:
        return knn.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("d").cast("double")).mapInArrow(run_together, "i long, j long, p double")

    def run(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # the edges of the last point so far
        for b in batches:
            if not len(b):
                continue
            js, ds = b.column(1), b.column(2)
            count = js.value_lengths().to_numpy()
            edges = [np.r_[x, y] for x, y in zip(kept, (np.repeat(b.column(0).to_numpy(), count), from_steps(js), ds.flatten().to_numpy(zero_copy_only=False)), strict=True)]
            at = np.searchsorted(edges[0], edges[0][-1])
            kept = [x[at:] for x in edges]
            yield from calibrate(*(x[:at] for x in edges))
        yield from calibrate(*kept)

    return packed(knn).repartition("i").sortWithinPartitions("i").mapInArrow(run, "i long, j long, p double")


def joint_distribution(p: DataFrame) -> DataFrame:
    """(i, j, p): conditional probabilities of both directions, divided by the sum of all."""
    both = p.select("i", "j", "p").unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    sums = both.groupBy("i", "j").agg(F.sum("p").alias("p"))
    # Both directions hold the same mass; the total is one row.
    total = p.agg((2 * F.sum("p")).alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("i", "j", (F.col("p") / F.col("total")).alias("p"))


def joint_rows(joint: DataFrame) -> DataFrame:
    """(i, row): each point's partners and probabilities as one array, ordered by partner."""
    return joint.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("row"))
