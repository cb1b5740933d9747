"""Registered queries over whole tables, against brute force on small fixtures."""

import math

import numpy as np

import __spark_entry__ as entry


def test_distance_matrix_of_all_points(spark, tmp_path):
    rng = np.random.default_rng(4)
    ids, x = [*range(5, 30), 115], rng.normal(size=(26, 6)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.i, r.j): r.p for r in entry.queries()["distance_matrix_affinities"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, j) for i in ids for j in ids}
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    for k, i in enumerate(ids):
        low, high = 0.0, 1e6  # the entropy falls as beta grows
        for _ in range(200):
            beta = (low + high) / 2
            w = np.exp(-d[k] * beta)
            low, high = (beta, high) if math.log(w.sum()) + beta * (d[k] * w).sum() / w.sum() > math.log(5.0) else (low, beta)
        assert np.abs(np.array([got[i, j] for j in ids]) / 1e6 - w / w.sum()).max() < 1e-4
