"""Iterations whose working set is counted to be small: positions and pyramid are handed to the tasks, the edges stay with them.

An iteration is one job of one stage, without a plan, a shuffle or a written table. Each task takes the edges of its own points and a run of
neighbouring points for the repulsion; five numbers a point come back, and the step is made on the driver. Larger working sets go by tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .layout import MIN_GAIN
from .tree import DEPTH, all_pairs, children, near_order, traverse, width_of

#: Points up to which the working set is held: 56 bytes each.
HELD_POINTS = 200_000


@dataclass
class Held:
    """A working set by ascending id: positions, velocities and gains of shape (points, 2)."""

    i: np.ndarray
    y: np.ndarray
    u: np.ndarray
    g: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({"i": self.i, "y0": self.y[:, 0], "y1": self.y[:, 1]}))

    def width(self) -> float:
        """The half-width of the tree's root."""
        low, high = (self.y.min(0), self.y.max(0)) if len(self.y) else ([None] * 2, [None] * 2)
        return width_of(low[0], high[0], low[1], high[1])


@dataclass
class Forces:
    """Of each point: pull, push, sum of q, and whether it has edges. terms: of the loss, before the sum of all q is known."""

    pull: np.ndarray
    push: np.ndarray
    sq: np.ndarray
    met: np.ndarray
    terms: np.ndarray

    def losses(self) -> tuple[float, float]:
        """(loss, kl), as layout.losses()."""
        a, s, b, t = self.terms
        z = np.log(self.sq.sum())
        return float(a + s * z), float(b + t * z)


def working_set(state: DataFrame) -> Held | None:
    """state (a written table) in arrays, or None if it has more than HELD_POINTS rows."""
    if state.limit(HELD_POINTS + 1).count() > HELD_POINTS:
        return None
    t = state.select("i", "y0", "y1", "u0", "u1", "g0", "g1").toArrow().sort_by("i")
    pair = lambda c: np.stack([t[f"{c}0"].to_numpy(), t[f"{c}1"].to_numpy()], 1)
    return Held(t["i"].to_numpy(), pair("y"), pair("u"), pair("g"))


def dealt_edges(joint: DataFrame) -> RDD:
    """The joint distribution as rows of packed runs (i, j, p), dealt and sorted by i and kept; a lost part is made again from joint.

    A session may deal them to more partitions than there are cores, each of which would cost every iteration a task.
    """

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=["i", "j", "p"])

    parts = joint.sparkSession.sparkContext.defaultParallelism
    rows = joint.select("i", "j", "p").repartition(parts, "i").sortWithinPartitions("i", "j").mapInArrow(pack, "i binary, j binary, p binary")
    return rows.rdd.coalesce(parts).map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def low_q(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 / (1 + the metric between the rows of a and b), as layout.low_distance()."""
    if metric == "cosine":
        norm = np.sqrt((a[:, 0] * a[:, 0] + a[:, 1] * a[:, 1]) * (b[:, 0] * b[:, 0] + b[:, 1] * b[:, 1]))
        return 1 / (2 - np.divide(a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1], norm, out=np.zeros_like(norm), where=norm != 0))
    d = a - b
    square = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
    return 1 / (1 + (square if metric == "sqeuclidean" else np.sqrt(square)))


def place(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of these is among the sorted ids, and whether it is."""
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return at, ids[at] == of


def pulled(rows: Iterator, ids: np.ndarray, y: np.ndarray, metric: str, scale: float, logged: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the points with edges, their pull, and the loss terms of these edges."""
    pull, met, terms = np.zeros((len(ids), 2)), np.zeros(len(ids), bool), np.zeros(4)
    for packed in rows:
        (a, known_a), (b, known_b) = (place(ids, np.frombuffer(x, np.int64)) for x in packed[:2])
        p, known = np.frombuffer(packed[2], np.float64), known_a & known_b
        a, b, p = a[known], b[known], p[known]
        if not len(a):
            continue
        q = low_q(metric, y[a], y[b])
        first = a.min()
        some = pull[first : a.max() + 1]
        for c in (0, 1):
            some[:, c] += np.bincount(a - first, p * scale * q * (y[a, c] - y[b, c]), len(some))
        met[a] = True
        if logged:
            t, q = p[p > 0], q[p > 0]
            s = t * scale
            terms += (s * np.log(s / q)).sum(), s.sum(), (t * np.log(t / q)).sum(), t.sum()
    at = np.flatnonzero(met)
    return at, pull[at], terms


def pyramid(y: np.ndarray, width: float, depth: int = DEPTH) -> list[dict]:
    """Per level, the sorted codes of the tree's cells and their n, centroid and leaf, as tree.cell_pyramid()."""
    out = []
    for level in range(depth + 1):
        side, most = 2 * width / 2.0**level, 2**level - 1
        cx = np.clip(np.ceil((y[:, 0] + width) / side) - 1, 0, most).astype(np.int64)
        cy = np.clip(np.floor((y[:, 1] + width) / side), 0, most).astype(np.int64)
        code = (cx << 31) | cy
        order = np.argsort(code, kind="stable")
        code, y = code[order], y[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        n = np.diff(begin, append=len(code))
        low, high = np.minimum.reduceat(y, begin), np.maximum.reduceat(y, begin)
        leaf = (low == high).all(1)
        mean = np.where(leaf[:, None], low, np.add.reduceat(y, begin) / n[:, None])
        out.append({"code": code[begin], "n": n, "mean": mean, "leaf": leaf})
        left = np.repeat(~leaf, n)
        y, code = y[left], code[left]
        if not len(y):
            return out
    order = np.lexsort((y[:, 1], y[:, 0], code))
    code, y = code[order], y[order]
    begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (y[1:] != y[:-1]).any(1)))
    return [*out, {"code": code[begin], "n": np.diff(begin, append=len(code)), "mean": y[begin], "leaf": np.ones(len(begin), bool)}]


def forces(edges: RDD, state: Held, metric: str, theta: float, scale: float, logged: bool) -> Forces:
    """One job: the pull of the edges, the push of all points, and every tenth time the terms of the loss."""
    sc, parts, n = edges.context, edges.getNumPartitions(), len(state.i)
    width = state.width()
    near = np.argsort(near_order(state.y, width), kind="stable")
    cells = pyramid(state.y, width) if theta > 0 and n else []
    given = sc.broadcast((state.i, state.y, near, cells, children(cells)))

    def run(k: int, rows: Iterator) -> Iterator:
        ids, y, near, cells, below = given.value
        at = np.array_split(near, parts)[k]
        push, sq = traverse(y[at], cells, theta, width, below=below) if theta > 0 else all_pairs(y[at], y)
        yield at, push, sq, *pulled(rows, ids, y, metric, scale, logged)

    out = Forces(np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(n), np.zeros(n, bool), np.zeros(4))
    if n:
        for at, push, sq, own, pull, terms in edges.mapPartitionsWithIndex(run).collect():
            out.push[at], out.sq[at], out.pull[own], out.met[own] = push, sq, pull, True
            out.terms += terms
    given.destroy()
    return out


def updated(state: Held, f: Forces, momentum: float, rate: float, min_gain: float = MIN_GAIN) -> Held:
    """The working set after one step, not centred, as layout.update_embedding(): of the points that have edges."""
    d = (f.pull - f.push / f.sq.sum())[f.met]
    y, u, g = (x[f.met] for x in (state.y, state.u, state.g))
    g = np.maximum(np.where((d > 0) == (u > 0), g * 0.8, g + 0.2), min_gain)
    u = momentum * u - rate * g * d
    return Held(state.i[f.met], y + u, u, g)


def centred(state: Held) -> Held:
    return Held(state.i, state.y - state.y.mean(0) if len(state.i) else state.y, state.u, state.g)
