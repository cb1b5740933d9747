"""Jobs over all pairs whose disk follows the points: rows of distances are calibrated where they are made, large pyramids are taken by parts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.operators import affinity, knn, tree
from driftmap.plans import registry


def vectors(spark, n=60):
    x = np.random.default_rng(3).normal(size=(n, 5))
    x[7] = x[3]
    return spark.createDataFrame([(i - 9 if i % 11 else 4, [float(c) for c in r]) for i, r in enumerate(x)], "i long, x array<double>")


def rows(df):
    return sorted((r.i, r.j, round(r.p, 9)) for r in df.collect())


def test_affinities_of_all_pairs_are_not_shuffled(spark, sf, monkeypatch):
    plan = registry.distance_matrix_affinities(spark, sf)._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # 9 bytes a pair before
    monkeypatch.setattr(knn, "STRIP", 150)
    v = vectors(spark)  # with rows that share an id
    got = rows(affinity.all_affinities(v, 3.0))
    assert got == rows(affinity.pairwise_affinities(knn.all_distances(v), 3.0)) and len(got) == 3600
    monkeypatch.setattr(knn, "HELD_BYTES", 10)
    assert knn.whole(v) is None and rows(affinity.all_affinities(v, 3.0)) == got


def test_search_leaves_out_only_what_changes_no_sum():
    rng = np.random.default_rng(4)
    d = np.concatenate([rng.random(900) * s for s in (1e-9, 1.0, 1e4, 1e9)] + [[0.0, np.inf, 3.0, np.nan, 5.0]])
    begin = np.array([0, 900, 1800, 2700, 3600])
    p = affinity.weights(d, begin, 5.0)
    for a, b in zip(begin[:4], begin[1:], strict=True):
        h = -(p[a:b][p[a:b] > 0] * np.log(p[a:b][p[a:b] > 0])).sum()
        assert abs(p[a:b].sum() - 1) < 1e-12 and (a == 0 or abs(h - np.log(5.0)) < 1.1e-5)
    assert np.isnan(p[3603]) and p[3601] == 0 and abs(np.nansum(p[3600:]) - 1) < 1e-12


@pytest.mark.parametrize("edges", [1 << 25, 60_000])
def test_distance_csv_goes_by_runs_of_points(spark, sf, monkeypatch, edges):
    monkeypatch.setattr(registry, "CSV_EDGES", edges)
    made = []
    monkeypatch.setattr(registry, "csv_of", lambda df, name, f=registry.csv_of: made.append(f(df, name)) or made[-1])
    got = registry.csv_distance_affinities(spark, sf)
    assert len(made) == -(-500 // (edges // 500)) and not any(os.path.exists(m.removeprefix("file://")) for m in made)
    want = registry.distance_matrix_affinities(spark, sf)
    assert got.count() == 250_000 and not got.exceptAll(want).count()
