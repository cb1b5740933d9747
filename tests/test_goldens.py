"""Golden values of FIXTURES.md, invariants and edge cases."""

import math
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.functions.metrics import metric
from driftmap.operators import affinity, knn, layout, tree
from driftmap.plans import cli, pipeline
from driftmap.plans.pipeline import Settings, embed, explain, phases, step
from driftmap.sources import coo

TEXT = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")).read()


def section(n):
    return re.search(rf"\n## {n}\. .*?(?=\n## |\Z)", TEXT, re.S)[0]


def rows_of(text, columns):
    rows = (re.findall(r"[^|\s]+", x) for x in text.split("\n") if re.match(r"\| \d", x))
    return [r for r in rows if len(r) == columns]


PAIRWISE = [(int(r[0]), j, float(v)) for r in rows_of(section(3), 11) for j, v in enumerate(r[1:]) if v != "-"]
GRADIENT = [(int(r[0]), *map(float, r[1:])) for r in rows_of(section(5), 5)]
START = [(i, a, b) for i, a, b, _, _ in GRADIENT]
VELOCITY, MOVED = (rows_of(x, 5) for x in section(6).split("Updated `y`"))


@pytest.fixture(scope="module")
def joint(spark):
    return affinity.joint_distribution(spark.createDataFrame(PAIRWISE, "i long, j long, p double")).cache()


def state(spark):
    return spark.createDataFrame([(i, a, b, 0.0, 0.0, 1.0, 1.0) for i, a, b in START], "i long, y0 double, y1 double, u0 double, u1 double, g0 double, g1 double")


def line(spark, n=9):
    return spark.createDataFrame([(i, [float(i)] * 4) for i in range(n)], "i long, x array<double>")


@pytest.mark.parametrize("method", [lambda v: knn.knn_bruteforce(v, 2), lambda v: knn.knn_blocked(v, 2, blocks=4), lambda v: knn.knn_blocked(v, 2, blocks=20), lambda v: knn.knn_zorder(v, 2, iterations=8)])
def test_knn_golden(spark, method):
    want = {(i, j, 4.0) for i in range(9) for j in (i - 1, i + 1) if 0 <= j < 9} | {(0, 2, 16.0), (8, 6, 16.0)}
    assert {tuple(r) for r in method(line(spark)).collect()} == want


def test_knn_ties_duplicates_and_few_points(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(5)], "i long, x array<double>")
    for df in (knn.knn_bruteforce(v, 2), knn.knn_blocked(v, 2, blocks=3)):
        assert {tuple(r) for r in df.collect()} == {(i, j, 0.0) for i in range(5) for j in [x for x in range(5) if x != i][:2]}
    assert knn.knn_bruteforce(v, 50).count() == knn.knn_blocked(v, 50, blocks=3).count() == 20
    assert knn.knn_zorder(v, 2, iterations=1).count() == 10


def test_morton_order_is_the_order_of_interleaved_bits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    keys = knn.morton_keys(x)

    def before(a, b):
        whole = [[(~v if v >> 63 else v | 1 << 63) & 2**64 - 1 for v in map(int, np.array(p).view(np.uint64))] for p in (a, b)]
        _, _, j = max(((p ^ q).bit_length(), -k, k) for k, (p, q) in enumerate(zip(*whole, strict=True)))
        return whole[0][j] < whole[1][j]

    assert all((keys[k] < keys[k + 1]) == before(x[k], x[k + 1]) for k in range(299))


def test_curve_recall_grows_with_passes(spark, sf):
    v = coo.read_vectors(spark, f"{sf}/embeddings.parquet")
    exact = {(r.i, r.j) for r in knn.knn_bruteforce(v, 15).collect()}
    recall = [len(exact & {(r.i, r.j) for r in knn.knn_zorder(v, 15, iterations=n).collect()}) / len(exact) for n in (1, 3, 10)]
    assert recall == pytest.approx([0.10, 0.27, 0.63], abs=0.07)


def test_cosine_with_zero_vector_and_unknown_metric(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>, c array<double>").select(metric("cosine")(F.col("a"), F.col("b")), metric("cosine")(F.col("b"), F.col("c")), metric("euclidean")(F.col("a"), F.col("b"))).first()
    assert row[0] == 1 and row[1] == pytest.approx(0) and row[2] == pytest.approx(math.sqrt(5))
    with pytest.raises(ValueError):
        metric("manhattan")
    with pytest.raises(ValueError):
        embed(line(spark), Settings(knn_method="none", perplexity=1.0))


def test_joint_dense_golden(joint):
    got = {(r.i, r.j): r.p for r in joint.collect()}
    assert len(got) == 90 and sum(got.values()) == pytest.approx(1, abs=1e-12)
    assert got[0, 1] == pytest.approx(3.980952007665e-02, abs=1e-12) and got[6, 8] == pytest.approx(8.439044182053e-02, abs=1e-12)
    assert sum((i + 1) * (j + 2) * p for (i, j), p in got.items()) == pytest.approx(41.029336931, abs=1e-8)


def test_joint_sparse_golden(spark):
    given, golden = section(8).split("Golden:")
    read = lambda t: [(int(a), int(b), float(p)) for a, b, p in re.findall(r"(\d+)->(\d+) ([\d.]+\d)", t)]
    got = {(r.i, r.j): r.p for r in affinity.joint_distribution(spark.createDataFrame(read(given), "i long, j long, p double")).collect()}
    want = {(i, j): p for i, j, p in read(golden)}
    assert got.keys() == want.keys() and all(abs(got[k] - p) < 1e-6 for k, p in want.items())


def test_conditional_affinities(spark, sf):
    near = knn.knn_bruteforce(coo.read_vectors(spark, f"{sf}/embeddings.parquet"), 15).cache()
    rows = affinity.calibrated(near, 5.0)
    beta = rows.agg(F.avg("beta")).first()[0]
    assert beta == pytest.approx(21.46409167480469, abs=1e-6)
    p = affinity.pairwise_affinities(near, 5.0).groupBy("i").agg(F.sum("p").alias("s"), (-F.sum(F.col("p") * F.log("p"))).alias("h"))
    assert all(abs(r.s - 1) < 1e-12 and abs(r.h - math.log(5)) < 1e-4 for r in p.collect())


def test_unreachable_perplexity_and_underflow(spark):
    one = spark.createDataFrame([(0, 1, 2.0), (5, 1, 1e9), (5, 2, 1e9)], "i long, j long, d double")
    got = {(r.i, r.j): r.p for r in affinity.pairwise_affinities(one, 2.0).collect()}
    assert got[0, 1] == pytest.approx(1) and set(got) == {(0, 1), (5, 1), (5, 2)}


def test_center_golden(spark):
    df = spark.createDataFrame([(0, -2.0, 4.0), (1, -6.0, 4.0), (2, 2.0, -8.0)], "i long, y0 double, y1 double")
    assert {tuple(r) for r in layout.center_embedding(df).collect()} == {(0, 0.0, 4.0), (1, -4.0, 4.0), (2, 4.0, -8.0)}
    x = layout.center_input(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 6.0])], "i long, x array<double>"))
    assert {(r.i, *r.x) for r in x.collect()} == {(0, -1.0, -2.0), (1, 1.0, 2.0)}


def test_gradient_golden(spark, joint):
    y = state(spark).select("i", "y0", "y1")
    for theta_zero in (layout.gradient(joint, y, theta=0.0).collect(),):
        got = {r.i: (r.d0, r.d1) for r in theta_zero}
        assert all(got[i] == pytest.approx((a, b), abs=1e-12) for i, _, _, a, b in GRADIENT)
    z = layout.repulsion_exact(y).agg(F.sum("sq")).first()[0]
    assert z == pytest.approx(33.65625463923, abs=1e-9)


def test_update_and_iteration_golden(spark, joint):
    s = state(spark)
    moved = {r.i: r for r in layout.update_embedding(layout.gradient(joint, s, theta=0.0), s, 0.5, 300.0).collect()}
    for i, u0, u1, g0, g1 in VELOCITY:
        r = moved[int(i)]
        assert (r.u0, r.u1, r.g0, r.g1) == pytest.approx(tuple(map(float, (u0, u1, g0, g1))), abs=1e-9)
    one = {r.i: r for r in step(joint, s, Settings(theta=0.0, learning_rate=300.0, perplexity=2.0), False, False).collect()}
    for i, y0, y1, c0, c1 in MOVED:
        assert (moved[int(i)].y0, moved[int(i)].y1, one[int(i)].y0, one[int(i)].y1) == pytest.approx(tuple(map(float, (y0, y1, c0, c1))), abs=1e-9)


def plain_tree(points, theta, depth=30):
    """Repulsion by a recursive quadtree."""
    w = max(np.ptp(points[:, 0]), np.ptp(points[:, 1]), np.abs(points).max())

    def build(idx, cx, cy, half, level):
        p = points[idx]
        node = {"n": len(idx), "c": p.mean(0), "half": half, "idx": set(idx.tolist()), "leaf": level == depth or (p == p[0]).all(), "kids": []}
        if not node["leaf"]:
            east, north = p[:, 0] > cx, p[:, 1] >= cy
            for e in (False, True):
                for n in (False, True):
                    own = idx[(east == e) & (north == n)]
                    if len(own):
                        node["kids"].append(build(own, cx + (half / 2 if e else -half / 2), cy + (half / 2 if n else -half / 2), half / 2, level + 1))
        else:
            node["c"] = p[0]
        return node

    root = build(np.arange(len(points)), 0.0, 0.0, w, 0)

    def visit(i, node):
        delta = points[i] - node["c"]
        d = delta @ delta
        if node["leaf"] or node["half"] < theta * d:
            q = 1 / (1 + d)
            n = node["n"] - (node["leaf"] and i in node["idx"])
            return np.array([*(n * q * q * delta), n * q])
        return sum((visit(i, k) for k in node["kids"]), np.zeros(3))

    return np.array([visit(i, root) for i in range(len(points))])


@pytest.mark.parametrize("theta", [0.0, 0.25, 0.5, 1.0])
def test_barnes_hut_equals_a_plain_tree(spark, theta):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(size=(150, 2)), [[0, 0], [0, 0.5], [0.5, 0], [0.25, 0.25], [0.25, 0.25]]])
    y = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "i long, y0 double, y1 double")
    want = plain_tree(p, theta, 16)
    for df in (tree.repulsion_barnes_hut(y, theta, 16), *([tree.repulsion_by_joins(y, theta, 16)] if theta == 0.5 else [])):
        got = np.array([[r.r0, r.r1, r.sq] for r in sorted(df.collect())])
        assert np.abs(got - want).max() < 1e-9
    if theta == 0:
        exact = np.array([[r.r0, r.r1, r.sq] for r in sorted(layout.repulsion_exact(y).collect())])
        assert np.abs(want - exact).max() < 1e-9


def test_init_is_seeded_and_independent_of_partitions(spark):
    ids = spark.range(500).withColumnRenamed("id", "i")
    a, b, c = (sorted(map(tuple, layout.init_working_set(df, s).collect())) for df, s in ((ids.repartition(7), 1), (ids.coalesce(1), 1), (ids, 2)))
    assert a == b != c
    y = np.array([r[1:3] for r in a])
    assert np.abs(y.std(0) - 1e-4).max() < 1e-5 and abs(np.corrcoef(y.T)[0, 1]) < 0.15 and all(r[3:] == (0.0, 0.0, 1.0, 1.0) for r in a)


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (20, (20, 0, 0)), (21, (20, 1, 0)), (101, (20, 81, 0)), (102, (20, 81, 1)), (300, (20, 81, 199))])
def test_schedule(n, want):
    assert tuple(x[0] for x in phases(n)) == want


def test_coo_reader_cli_and_plan(spark, tmp_path):
    (tmp_path / "in.csv").write_text("".join(f"{i},{c},{i * 0.1 + c}\n" for i in range(30) for c in range(3) if (i + c) % 4) + "0,1,1.0\n")
    v = {r.i: r.x for r in coo.coo_to_vectors(coo.read_coo(spark, str(tmp_path / "in.csv")), 4).collect()}
    assert len(v) == 30 and v[0] == [0.0, 2.0, 2.0, 0.0]
    common = ["--input", str(tmp_path / "in.csv"), "--dimension", "4", "--perplexity", "3", "--theta", "0"]
    cli.main([*common, "--output", str(tmp_path / "out"), "--knnMethod", "partition", "--iterations", "10", "--lossFile", str(tmp_path / "loss.txt")], spark)
    assert spark.read.csv(str(tmp_path / "out")).count() == 30 and (tmp_path / "loss.txt").read_text().startswith("{10=")
    (tmp_path / "d.csv").write_text("".join(f"{i},{(i + k) % 12},{k}.5\n" for i in range(12) for k in (1, 2, 3)))
    cli.main(["--input", str(tmp_path / "d.csv"), "--dimension", "1", "--knnMethod", "bruteforce", "--inputDistanceMatrix", "--perplexity", "2", "--iterations", "2", "--output", str(tmp_path / "out2"), "--loss", str(tmp_path / "loss2.txt")], spark)
    assert spark.read.csv(str(tmp_path / "out2")).count() == 12
    cli.main([*common, "--output", "x", "--knnMethod", "project", "--executionPlan", "--planFile", str(tmp_path / "plan.txt")], spark)
    assert "Physical Plan" in (tmp_path / "plan.txt").read_text()


def test_plan_of_the_whole_job_runs_nothing(spark):
    v = line(spark)
    for s in (Settings(knn_method="project", perplexity=1.0), Settings(knn_method="partition", perplexity=1.0, theta=0.0)):
        spark.sparkContext.setJobGroup("plan-only", "plans")
        text = explain(v, s)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
        spark.sparkContext.setJobGroup("tests", "tests")
        parts = text.split("== ")[1:]
        assert not jobs and all(f"== {x} ==" in text for x in ("neighbours", "joint distribution", "first working set", "repulsion", "step and centring", "loss")) and len(parts) > 6
        assert ("== pyramid ==" in text) == (s.theta > 0)


@pytest.mark.parametrize("gap", [1e-6, 1e-13])
def test_close_points_are_told_apart(spark, gap):
    """Pairs closer than a cell of level 16, and closer than one of the last level."""
    rng = np.random.default_rng(8)
    p = rng.normal(size=(30, 2))
    p = np.concatenate([p, p[:10] + [gap, 0], p[:10] + [0, 3 * gap], p[:5]])
    y = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "i long, y0 double, y1 double")
    exact = np.array([[r.r0, r.r1, r.sq] for r in sorted(layout.repulsion_exact(y).collect())])
    for theta in (0.0, 0.5):
        want = exact if theta == 0 else plain_tree(p, theta, 60)
        for df in (tree.repulsion_barnes_hut(y, theta), *([tree.repulsion_by_joins(y, theta)] if theta and gap < 1e-9 else [])):
            got = np.array([[r.r0, r.r1, r.sq] for r in sorted(df.collect())])
            assert np.abs(got - want).max() < 1e-9


def test_tiles_of_any_size_give_the_same_neighbours(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(k, [float(c) for c in x]) for k, x in enumerate(rng.integers(0, 4, (41, 3)))], "i long, x array<double>")
    want = {tuple(r) for r in knn.knn_bruteforce(v, 5).collect()}
    for blocks in (None, 1, 2, 7, 60):
        assert {tuple(r) for r in knn.knn_blocked(v, 5, blocks=blocks).collect()} == want


def test_all_phases_equal_plain_numpy_and_no_iteration_takes_longer(spark, monkeypatch):
    """40 iterations over three phases, of shorter lengths than by default: momentum, exaggeration and the loss log; constant time each."""
    n, rate = 24, 2.0
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(k, [float(c) for c in x]) for k, x in enumerate(rng.normal(size=(n, 5)))], "i long, x array<double>")
    joint = affinity.joint_distribution(affinity.pairwise_affinities(knn.knn_bruteforce(v, 6), 3.0)).cache()
    start = spark.createDataFrame([(k, float(a), float(b), 0.0, 0.0, 1.0, 1.0) for k, (a, b) in enumerate(rng.normal(size=(n, 2)))], "i long, y0 double, y1 double, u0 double, u1 double, g0 double, g1 double")
    p = np.zeros((n, n))
    for r in joint.collect():
        p[r.i, r.j] = r.p
    y = np.array([[r.y0, r.y1] for r in sorted(start.collect())])
    monkeypatch.setattr(pipeline, "phases", lambda count: [(8, True, False), (13, True, True), (count - 21, False, True)])
    times, own = [], pipeline.moved
    monkeypatch.setattr(pipeline, "moved", lambda *a: (times.append(time.time()), own(*a))[1])
    got = pipeline.optimize(joint, start, Settings(perplexity=3.0, neighbors=6, iterations=40, learning_rate=rate, theta=0.25))
    u, g, loss = np.zeros((n, 2)), np.ones((n, 2)), {}
    for it in range(1, 41):
        scale, momentum = (4.0 if it <= 21 else 1.0), (0.5 if it <= 8 else 0.8)
        push = plain_tree(y, 0.25)
        z = push[:, 2].sum()
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        if it % 10 == 0:
            at = p > 0
            loss[it] = (scale * p[at] * np.log(scale * p[at] / (q[at] / z))).sum()
        d = ((p * scale * q)[:, :, None] * (y[:, None] - y[None])).sum(1) - push[:, :2] / z
        g = np.maximum(np.where((d > 0) == (u > 0), g * 0.8, g + 0.2), 0.01)
        u = momentum * u - rate * g * d
        y = y + u
        y = y - y.mean(0)
    assert np.abs(np.array([[r.y0, r.y1] for r in sorted(got.embedding.collect())]) - y).max() < 1e-6
    assert got.loss == pytest.approx(loss, rel=1e-8) and sorted(loss) == [10, 20, 30, 40]
    each = np.diff(times)
    assert np.median(each[-10:]) < 2 * np.median(each[2:12]) + 0.5


def test_embedding_is_centred_and_its_loss_falls(spark, sf):
    v = coo.read_vectors(spark, f"{sf}/embeddings.parquet").where("i < 120")
    s = Settings(perplexity=5.0, neighbors=15, iterations=30, learning_rate=50.0, theta=0.25)
    r = embed(v, s)
    mean = r.embedding.agg(F.avg("y0"), F.avg("y1"), F.count("*")).first()
    assert abs(mean[0]) < 1e-9 and abs(mean[1]) < 1e-9 and mean[2] == 120
    assert sorted(r.loss) == [10, 20, 30] and all(math.isfinite(x) for x in r.kl.values()) and r.kl[30] < r.kl[10]
    assert "Physical Plan" in explain(v, s)
