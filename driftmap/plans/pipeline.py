"""The whole computation: neighbours, affinities, scheduled descent, loss log."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut, planning, released
from ..functions.metrics import metric as metric_of
from ..operators import affinity, held, knn, layout, tree


@dataclass
class Settings:
    metric: str = "sqeuclidean"
    perplexity: float = 30.0
    early_exaggeration: float = 4.0
    learning_rate: float = 1000.0
    iterations: int = 300
    random_state: int = 0
    neighbors: int | None = None
    initial_momentum: float = 0.5
    final_momentum: float = 0.8
    theta: float = 0.25
    knn_method: str = "bruteforce"
    knn_iterations: int = 3
    knn_blocks: int | None = None
    n_components: int = 2

    def __post_init__(self):
        metric_of(self.metric)
        if self.n_components != 2:
            raise ValueError("the layout has two components")
        if self.neighbors is None:
            self.neighbors = 3 * int(self.perplexity)
        if self.perplexity >= self.neighbors:
            warnings.warn("perplexity should be below the number of neighbours", stacklevel=3)


@dataclass
class Result:
    embedding: DataFrame
    loss: dict[int, float] = field(default_factory=dict)
    kl: dict[int, float] = field(default_factory=dict)


def phases(iterations: int) -> list[tuple[int, bool, bool]]:
    """(iterations, exaggerated, final momentum) of the three phases: 20, then 81, then the rest."""
    a = min(iterations, 20)
    b = min(iterations - a, 81)
    return [(a, True, False), (b, True, True), (iterations - a - b, False, True)]


def neighbours(vectors: DataFrame, s: Settings, dimension: int | None = None) -> DataFrame:
    if s.knn_method == "bruteforce":
        return knn.knn_bruteforce(vectors, s.neighbors, s.metric, s.knn_blocks)
    if s.knn_method == "partition":
        return knn.knn_blocked(vectors, s.neighbors, s.metric, s.knn_blocks)
    if s.knn_method == "project":
        return knn.knn_zorder(vectors, s.neighbors, s.metric, s.knn_iterations, s.random_state, dimension)
    raise ValueError(f"knn method '{s.knn_method}' not defined")


def step(joint: DataFrame, state: DataFrame, s: Settings, exaggerated: bool, final: bool, push: DataFrame | None = None) -> DataFrame:
    """One iteration: gradient, update, centring."""
    return layout.center_embedding(moved(joint, state, s, exaggerated, final, push))


def moved(joint: DataFrame, state: DataFrame | held.Held, s: Settings, exaggerated: bool, final: bool, push: DataFrame | held.Forces | None = None) -> DataFrame | held.Held:
    """The working set after one step, as a written table or held; not centred."""
    if isinstance(state, held.Held):
        return held.updated(state, push, s.final_momentum if final else s.initial_momentum, s.learning_rate)
    grad = layout.gradient(joint, state, s.metric, s.theta, s.early_exaggeration if exaggerated else 1.0, push)
    return cut(layout.update_embedding(grad, state, s.final_momentum if final else s.initial_momentum, s.learning_rate), "state")


def optimize(joint: DataFrame, state: DataFrame, s: Settings) -> Result:
    """All phases. Every tenth iteration logs the loss of the embedding that enters it."""
    small = held.working_set(state)
    return by_tables(joint, state, s) if small is None else by_held(joint, small, s)


def by_held(joint: DataFrame, state: held.Held, s: Settings) -> Result:
    """optimize() of a working set that is counted to be small: an iteration is one job without a plan or a written table."""
    edges, out, at = held.dealt_edges(joint), Result(None), 0
    for count, exaggerated, final in phases(s.iterations):
        for _ in range(count):
            at += 1
            push = held.forces(edges, state, s.metric, s.theta, s.early_exaggeration if exaggerated else 1.0, at % 10 == 0)
            if at % 10 == 0:
                out.loss[at], out.kl[at] = push.losses()
            state = held.centred(moved(edges, state, s, exaggerated, final, push))
    edges.unpersist()
    out.embedding = state.table(joint.sparkSession)
    return out


def by_tables(joint: DataFrame, state: DataFrame, s: Settings) -> Result:
    """optimize() of any working set.

    An iteration writes two tables, the repulsion and the state, and deletes those of the one before; its lineage and size estimates
    begin at files. The joint distribution is kept dealt by i; a lost part is read again from its written table.
    """
    joint = joint.repartition("i").persist(StorageLevel.MEMORY_AND_DISK)
    out, at, last, width = Result(state), 0, None, None
    for count, exaggerated, final in phases(s.iterations):
        for _ in range(count):
            at += 1
            push = cut(layout.repulsion(state, s.theta, width), "push")
            if at % 10 == 0:
                z = push.agg(F.sum("sq")).first()[0]
                out.loss[at], out.kl[at] = layout.losses(joint, state, z, s.metric, s.early_exaggeration if exaggerated else 1.0)
            new = moved(joint, state, s, exaggerated, final, push)
            state, width = layout.centered(new)
            released(push, *([last] if last is not None else []))
            last = new
    joint.unpersist()
    out.embedding = state.select("i", "y0", "y1")
    return out


def embed_knn(edges: DataFrame, s: Settings) -> Result:
    """From neighbour edges (i, j, d), such as a distance table taken as it is."""
    joint = cut(affinity.joint_distribution(cut(affinity.pairwise_affinities(edges, s.perplexity), "affinities")), "joint")
    return optimize(joint, cut(layout.init_working_set(joint, s.random_state), "state"), s)


def embed(vectors: DataFrame, s: Settings | None = None) -> Result:
    s = s or Settings()
    return embed_knn(neighbours(vectors, s), s)


def explain(vectors_or_edges: DataFrame, s: Settings, dimension: int = 2) -> str:
    """The plans of the whole job, without running any of it: what comes before the first iteration, then an iteration's parts.

    theta > 0 is shown with the pyramid's first levels, and the traversal by tasks that hold it.
    """
    s = replace(s, knn_blocks=s.knn_blocks or 1)  # else the points would be counted
    with planning():
        known = "j" in vectors_or_edges.columns
        edges = vectors_or_edges if known else neighbours(vectors_or_edges, s, dimension)
        joint = affinity.joint_distribution(affinity.pairwise_affinities(edges, s.perplexity))
        state = layout.init_working_set(joint, s.random_state)
        points = spark_table(state, "i long, y0 double, y1 double, u0 double, u1 double, g0 double, g1 double")
        weights = spark_table(state, "i long, j long, p double")
        parts = {"neighbours" if not known else "distances": edges, "joint distribution": joint, "first working set": state}
        if s.theta > 0:
            parts["pyramid"] = tree.level_cells(points, 1.0, 0, tree.SPAN)
            push = tree.traversal(points, pd.DataFrame({"level": [], "cx": [], "cy": [], "n": [], "mx": [], "my": [], "leaf": []}), s.theta, 1.0)
        else:
            push = layout.repulsion_exact(points)
        parts["repulsion"] = push
        parts["step and centring"] = step(weights, points, s, True, False, push)
        parts["loss"] = layout.loss_terms(weights, points, 1.0, s.metric, s.early_exaggeration)
    return "\n".join(f"== {name} ==\n{df._jdf.queryExecution().toString()}" for name, df in parts.items())


def spark_table(like: DataFrame, schema: str) -> DataFrame:
    """An empty stand-in for a written table."""
    return like.sparkSession.createDataFrame([], schema)
