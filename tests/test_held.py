"""Iterations on a held working set against those by tables."""

import numpy as np
import pytest

from driftmap.operators import held, layout, tree
from driftmap.plans import pipeline
from driftmap.plans.pipeline import Settings


def some(spark, n=60, alone=2):
    """A joint distribution of n points with equal places, a hub and a p of zero, and a working set that has two points more, without edges."""
    rng = np.random.default_rng(9)
    pairs = {(i, int(j)) for i in range(n) for j in [(i + 1) % n, (i + 7) % n, 0] if i != j}
    pairs |= {(j, i) for i, j in pairs}
    joint = spark.createDataFrame([(3 * i - 50, 3 * j - 50, 0.0 if i + j == 9 else float(rng.random() / len(pairs))) for i, j in sorted(pairs)], "i long, j long, p double")
    y = rng.normal(size=(n + alone, 2))
    y[5:8] = y[4]
    rows = [(3 * i - 50, *map(float, y[i]), 0.0, 0.0, 1.0, 1.0) for i in rng.permutation(n + alone).tolist()]
    return joint, spark.createDataFrame(rows, "i long, y0 double, y1 double, u0 double, u1 double, g0 double, g1 double")


@pytest.mark.parametrize("theta, metric", [(0.25, "sqeuclidean"), (0.0, "euclidean"), (0.5, "cosine")])
def test_held_steps_equal_those_by_tables(spark, theta, metric):
    joint, state = some(spark)
    s = Settings(perplexity=3.0, neighbors=6, iterations=1, learning_rate=5.0, theta=theta, metric=metric)
    small, edges, width = held.working_set(state), held.dealt_edges(joint), None
    for k in range(3):
        push = layout.repulsion(state, theta, width)
        z = push.agg({"sq": "sum"}).first()[0]
        f = held.forces(edges, small, metric, theta, 4.0, True)
        assert f.losses() == pytest.approx(layout.losses(joint, state, z, metric, 4.0), rel=1e-9)
        state, width = layout.centered(pipeline.moved(joint, state, s, True, k > 1, push))
        small = held.centred(pipeline.moved(edges, small, s, True, k > 1, f))
        want = np.array([[r[c] for c in ("y0", "y1", "u0", "u1", "g0", "g1")] for r in state.orderBy("i").collect()])
        assert small.i.tolist() == [r.i for r in state.orderBy("i").collect()] and len(small.i) == 60
        assert np.abs(np.hstack([small.y, small.u, small.g]) - want).max() < 1e-9
    edges.unpersist()


def test_an_iteration_is_one_job(spark):
    joint, state = some(spark, alone=0)
    joint, state = joint.cache(), state.cache()
    jobs = []
    for n in (3, 9):
        spark.sparkContext.setJobGroup(f"steps-{n}", "steps")
        pipeline.optimize(joint, state, Settings(perplexity=3.0, neighbors=6, iterations=n, learning_rate=5.0))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{n}")))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[1] - jobs[0] == 6  # by tables, an iteration was about 20 jobs, whose plans and threads filled the driver


def test_an_iteration_over_filled_caches_is_one_job(spark):
    """The test above counts the jobs that fill both caches to its first run, of 3 steps."""
    joint, state = some(spark, alone=0)
    joint, state = joint.cache(), state.cache()
    assert joint.count() and state.count()
    jobs = []
    for n in (3, 9):
        spark.sparkContext.setJobGroup(f"filled-{n}", "steps")
        pipeline.optimize(joint, state, Settings(perplexity=3.0, neighbors=6, iterations=n, learning_rate=5.0))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"filled-{n}")))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[1] - jobs[0] == 6


def test_more_points_than_are_held_go_by_tables(spark, monkeypatch):
    joint, state = some(spark, alone=0)
    s = Settings(perplexity=3.0, neighbors=6, iterations=3, learning_rate=5.0)
    want = {r.i: (r.y0, r.y1) for r in pipeline.optimize(joint, state, s).embedding.collect()}
    monkeypatch.setattr(held, "HELD_POINTS", 59)
    assert held.working_set(state) is None
    got = {r.i: (r.y0, r.y1) for r in pipeline.optimize(joint, state, s).embedding.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


@pytest.mark.parametrize("gap, depth", [(1e-6, 30), (1e-13, 30), (1e-2, 4)])
def test_held_pyramid_equals_that_by_tables(spark, gap, depth):
    y = np.random.default_rng(3).normal(size=(40, 2))
    y[10:20] = y[:10] + gap
    y[20:25] = y[:5]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], "i long, y0 double, y1 double")
    width = tree.root_width(df)
    got = [(level, int(c >> 31), int(c & (2**31 - 1)), int(n), *m, bool(leaf)) for level, t in enumerate(held.pyramid(y, width, depth)) for c, n, m, leaf in zip(t["code"], t["n"], t["mean"].tolist(), t["leaf"], strict=True)]
    want = [tuple(r) for r in tree.cell_pyramid(df, depth, width).collect()]
    got, want = sorted(got), sorted(want)
    assert [r[:4] + r[6:] for r in got] == [r[:4] + r[6:] for r in want]
    assert np.allclose([r[4:6] for r in got], [r[4:6] for r in want], rtol=1e-14, atol=1e-15)
