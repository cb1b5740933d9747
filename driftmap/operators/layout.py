"""Layout: initial working set, exact gradient, attraction, loss, update and centring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from ..functions.metrics import spread
from .tree import repulsion_barnes_hut, width_of

MIN_GAIN = 0.01


def uniform(i: Column, stream: int, seed: int) -> Column:
    """A uniform number in (0, 1] from the hash of seed, id and stream: the same on any partitioning."""
    text = F.concat(F.lit(f"{seed}:"), i.cast("string"), F.lit(f":{stream}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))


def init_working_set(points: DataFrame, seed: int = 0) -> DataFrame:
    """(i, y0, y1, u0, u1, g0, g1): normal positions of deviation 1e-4, no velocity, gains of 1."""
    ids = points.select("i").distinct()
    normal = lambda c: 1e-4 * F.sqrt(-2 * F.log(uniform(F.col("i"), 2 * c, seed))) * F.cos(2 * F.lit(3.141592653589793) * uniform(F.col("i"), 2 * c + 1, seed))
    return ids.select("i", normal(0).alias("y0"), normal(1).alias("y1"), *[F.lit(v).alias(c) for c, v in (("u0", 0.0), ("u1", 0.0), ("g0", 1.0), ("g1", 1.0))])


def low_distance(metric: str) -> Column:
    """The metric between (y0, y1) and (z0, z1)."""
    square = (F.col("y0") - F.col("z0")) * (F.col("y0") - F.col("z0")) + (F.col("y1") - F.col("z1")) * (F.col("y1") - F.col("z1"))
    if metric == "sqeuclidean":
        return square
    if metric == "euclidean":
        return F.sqrt(square)
    if metric == "cosine":
        norm = F.sqrt((F.col("y0") * F.col("y0") + F.col("y1") * F.col("y1")) * (F.col("z0") * F.col("z0") + F.col("z1") * F.col("z1")))
        return 1 - F.coalesce(F.try_divide(F.col("y0") * F.col("z0") + F.col("y1") * F.col("z1"), norm), F.lit(0.0))
    raise ValueError(f"Metric '{metric}' not defined")


def exact_sum(term: Column) -> Column:
    """The sum of terms of 1 at most: their multiples of 2**-30 add up without rounding (to 2**23), and the rest is too small to matter."""
    high = F.rint(term * 2.0**30) / 2.0**30
    return F.sum(high) + F.sum(term - high)


def repulsion_exact(y: DataFrame) -> DataFrame:
    """(i, r0, r1, sq): the sums over all other points, which no order of the points changes; N * N pairs by definition."""
    a, b = spread(y.select("i", "y0", "y1")), y.select(F.col("i").alias("j"), F.col("y0").alias("z0"), F.col("y1").alias("z1"))
    q = 1 / (1 + low_distance("sqeuclidean"))
    pairs = a.crossJoin(b).where("i <> j").select("i", q.alias("q"), (F.col("y0") - F.col("z0")).alias("dx"), (F.col("y1") - F.col("z1")).alias("dy"))
    return pairs.groupBy("i").agg(exact_sum(F.col("q") * F.col("q") * F.col("dx")).alias("r0"), exact_sum(F.col("q") * F.col("q") * F.col("dy")).alias("r1"), exact_sum(F.col("q")).alias("sq"))


def placed_edges(joint: DataFrame, y: DataFrame, metric: str = "sqeuclidean") -> DataFrame:
    """(i, j, p, q, dx, dy) of each edge of the joint distribution; q is not normalised."""
    a, b = y.select("i", "y0", "y1"), y.select(F.col("i").alias("j"), F.col("y0").alias("z0"), F.col("y1").alias("z1"))
    q = 1 / (1 + low_distance(metric))
    return joint.join(a, "i").join(b, "j").select("i", "j", "p", q.alias("q"), (F.col("y0") - F.col("z0")).alias("dx"), (F.col("y1") - F.col("z1")).alias("dy"))


def attraction(joint: DataFrame, y: DataFrame, metric: str = "sqeuclidean", scale: float = 1.0) -> DataFrame:
    """(i, a0, a1): the pull of each point's partners; scale multiplies p."""
    e = placed_edges(joint, y, metric)
    pull = F.col("p") * scale * F.col("q")
    return e.groupBy("i").agg(F.sum(pull * F.col("dx")).alias("a0"), F.sum(pull * F.col("dy")).alias("a1"))


def loss_terms(joint: DataFrame, y: DataFrame, z: float, metric: str = "sqeuclidean", scale: float = 1.0) -> DataFrame:
    """One row: loss with p scaled, kl with plain p; p = 0 adds nothing."""
    e = placed_edges(joint.where("p > 0"), y, metric)
    s, t = F.col("p") * scale, F.col("p")
    return e.agg(F.sum(s * F.log(s / (F.col("q") / z))).alias("loss"), F.sum(t * F.log(t / (F.col("q") / z))).alias("kl"))


def losses(joint: DataFrame, y: DataFrame, z: float, metric: str = "sqeuclidean", scale: float = 1.0) -> tuple[float, float]:
    return tuple(loss_terms(joint, y, z, metric, scale).first())


def repulsion(y: DataFrame, theta: float, width: float | None = None) -> DataFrame:
    return repulsion_barnes_hut(y, theta, width=width) if theta > 0 else repulsion_exact(y)


def gradient(joint: DataFrame, y: DataFrame, metric: str = "sqeuclidean", theta: float = 0.25, scale: float = 1.0, push: DataFrame | None = None) -> DataFrame:
    """(i, d0, d1): attraction minus repulsion over the sum of all q. push: the repulsion, if it is there already; it is read twice."""
    push = cut(repulsion(y, theta), "push") if push is None else push
    z = push.agg(F.sum("sq").alias("z"))
    both = attraction(joint, y, metric, scale).join(push, "i").crossJoin(F.broadcast(z))
    return both.select("i", (F.col("a0") - F.col("r0") / F.col("z")).alias("d0"), (F.col("a1") - F.col("r1") / F.col("z")).alias("d1"))


def update_embedding(grad: DataFrame, state: DataFrame, momentum: float, rate: float, min_gain: float = MIN_GAIN) -> DataFrame:
    """The working set after one step: gains shrink where gradient and velocity agree in sign and grow elsewhere."""
    df = state.join(grad, "i")
    cols = {}
    for c in "01":
        d, u, g = F.col(f"d{c}"), F.col(f"u{c}"), F.col(f"g{c}")
        gain = F.greatest(F.when((d > 0) == (u > 0), g * 0.8).otherwise(g + 0.2), F.lit(min_gain))
        cols[f"g{c}"], cols[f"u{c}"] = gain, momentum * u - rate * gain * d
    df = df.select("i", "y0", "y1", *[x.alias(n) for n, x in cols.items()])
    return df.select("i", (F.col("y0") + F.col("u0")).alias("y0"), (F.col("y1") + F.col("u1")).alias("y1"), "u0", "u1", "g0", "g1")


def center_embedding(state: DataFrame) -> DataFrame:
    """state with y0 and y1 moved to mean 0; state is read twice."""
    mean = state.agg(F.avg("y0").alias("m0"), F.avg("y1").alias("m1"))
    df = state.crossJoin(F.broadcast(mean))
    return df.withColumns({"y0": F.col("y0") - F.col("m0"), "y1": F.col("y1") - F.col("m1")}).drop("m0", "m1")


def centered(state: DataFrame) -> tuple[DataFrame, float]:
    """state (a written table) with y0 and y1 moved to mean 0, and the half-width of its tree's root, from one aggregate."""
    m0, m1, *ends = state.agg(F.avg("y0"), F.avg("y1"), F.min("y0"), F.max("y0"), F.min("y1"), F.max("y1")).first()
    if m0 is None:
        return state, width_of(None, 0, 0, 0)
    moved = state.withColumns({"y0": F.col("y0") - F.lit(m0), "y1": F.col("y1") - F.lit(m1)})
    return moved, width_of(ends[0] - m0, ends[1] - m0, ends[2] - m1, ends[3] - m1)


def center_input(vectors: DataFrame) -> DataFrame:
    """(i, x) less the mean vector."""
    flat = vectors.select("i", F.posexplode("x").alias("c", "v"))
    mean = flat.groupBy("c").agg(F.avg("v").alias("m"))
    mean = mean.agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("mean")).select(F.col("mean.m").alias("mean"))
    return vectors.crossJoin(F.broadcast(mean)).select("i", F.zip_with("x", "mean", lambda a, b: a - b).alias("x"))
