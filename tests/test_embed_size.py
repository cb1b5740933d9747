"""What embed_map's tasks hold and do at size."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from driftmap.operators import held, knn, tree


class Groups:
    """A grouped table that keeps the function it is to be run by."""

    def groupBy(self, *_):
        return self

    def applyInPandas(self, run, _):
        self.run = run
        return self


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_a_tile_of_equal_vectors_holds_few_candidates(monkeypatch, spread):
    groups = Groups()
    monkeypatch.setattr(knn, "block_pairs", lambda *_: groups)
    monkeypatch.setattr(knn, "nearest", lambda *_: None)
    knn.knn_blocked(None, 15, blocks=2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=8) + spread * rng.normal(size=(4000, 8))
    t = pd.DataFrame({"i": np.arange(4000), "x": list(x), "b": np.arange(4000) % 2, "p": 0, "q": 1})
    tracemalloc.start()
    out = groups.run(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 60000 and peak < 100e6  # the tile has 32 MB; all four million pairs of equal vectors at once took over 350 MB
    for i in (0, 1, 99, 2001, 3999):
        js = np.arange(1 - i % 2, 4000, 2)
        d = ((x[js] - x[i]) ** 2).sum(1)
        by = np.lexsort((js, d))[:15]
        got = out[out.i == i]
        assert got.j.tolist() == js[by].tolist() and np.allclose(got.d, d[by], rtol=1e-12)


def test_cells_that_all_stop_at_are_summed_by_products(monkeypatch):
    """Where an embedding is small, every point meets every other: by differences, 51,282 points took 60 CPU seconds an iteration."""
    y = np.random.default_rng(1).normal(size=(600, 2)) * 1e-4
    y[5:8] = y[4]
    width, seen, plain = tree.width_of(y[:, 0].min(), y[:, 0].max(), y[:, 1].min(), y[:, 1].max()), [], tree.summed
    monkeypatch.setattr(tree, "summed", lambda x, mean, *a: seen.append(len(x) * len(mean)) or plain(x, mean, *a))
    force, total = tree.traverse(y, held.pyramid(y, width), 0.25, width)
    assert sum(seen) < 600 * 600 / 20
    for k in (0, 4, 5, 300, 599):
        d = y[k] - y
        q = 1 / (1 + (d * d).sum(1))
        q[k] = 0
        assert total[k] == pytest.approx(math.fsum(q), rel=1e-14)
        assert force[k] == pytest.approx([math.fsum(q * q * d[:, c]) for c in (0, 1)], abs=1e-15)


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e4, 1e8, 1e160])
def test_products_lose_no_digits_at_any_scale(scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(64, 2)) * scale
    mean = np.concatenate([x[:20], x[:20] + 1e-3, rng.normal(size=(100, 2)) * scale * 9])
    n, leaf = np.r_[np.full(20, 3), np.full(20, 1), np.arange(1, 101)], np.r_[np.ones(40, bool), np.zeros(100, bool)]
    with np.errstate(all="ignore"):
        got, want = tree.summed_whole(x, mean, n, leaf), tree.summed(x, mean, n, leaf)
    assert np.allclose(got, want, rtol=1e-11, atol=1e-13 * abs(want).max())


def test_edges_lie_in_no_more_parts_than_there_are_cores(spark, monkeypatch):
    frame = type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: dealt(self, 211, *by))  # as a session with many partitions may have it
    joint = spark.createDataFrame([(i, j, 0.01) for i in range(40) for j in range(40) if i != j], "i long, j long, p double")
    edges = held.dealt_edges(joint)
    got = [(int(a), int(b)) for r in edges.collect() for a, b in zip(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.int64), strict=True)]
    assert edges.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert len(got) == 40 * 39 and len(set(got)) == 40 * 39
    edges.unpersist()
