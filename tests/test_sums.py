"""Sums of many forces are right to the last digits of a double, in whatever order they are added."""

import math

import numpy as np
from pyspark.sql import functions as F

from driftmap.operators import layout


def points(n):
    return np.random.default_rng(5).normal(size=(n, 2)) * 1.25


def wanted(y):
    """r0, r1 and the sum of q of all pairs, each sum rounded once."""
    out = []
    for k, a in enumerate(y):
        d = np.delete(a - y, k, 0)
        q = 1 / (1 + (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]))
        out.append([math.fsum(q * q * d[:, 0]), math.fsum(q * q * d[:, 1]), math.fsum(q)])
    return np.array(out)


def off(got, want):
    """The largest difference, in units of the last place, of 1 at least."""
    return (np.abs(got - want) / np.spacing(np.maximum(np.abs(want), 1))).max()


def test_exact_repulsion_does_not_depend_on_the_order(spark):
    y = points(1500)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], "i long, y0 double, y1 double")
    one, other = ([list(r)[1:] for r in layout.repulsion_exact(t).orderBy("i").collect()] for t in (df.coalesce(1).sort("i"), df.coalesce(1).sort(F.desc("y0"))))
    assert one == other and off(np.array(one), wanted(y)) <= 2
