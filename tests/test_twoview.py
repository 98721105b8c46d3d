"""Relative poses of view pairs with outliers on known scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from navlytics.plans import twoview as T
from tests.test_refinement import rodrigues

COLS = "pair long, kp long, x0 double, y0 double, x1 double, y1 double"


def views(pair, n, outliers, seed):
    """Rows of one pair with the rotation and the direction of its second view; the first ``outliers`` rows are wrong."""
    rng = np.random.default_rng(seed)
    rot, t = rodrigues(rng.normal(0, 0.1, 3)), rng.normal(0, 1, 3) * [6, 4, 2]
    t *= 6 / np.linalg.norm(t)  # depths of 10 to 20 baselines
    p = rng.uniform(-30, 30, (n, 3)) + [0, 0, 90]
    a, b = p[:, :2] / p[:, 2:], p @ rot.T + t
    b = b[:, :2] / b[:, 2:]
    b[:outliers] = rng.uniform(-0.4, 0.4, (outliers, 2))
    return [(pair, k, *map(float, a[k]), *map(float, b[k])) for k in range(n)], rot, t / np.linalg.norm(t)


def quat_matrix(q):
    w, x, y, z = q.w, q.x, q.y, q.z
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
                     [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
                     [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def solved(spark):
    cases = {p: views(p, 60, 20, p) for p in range(5)}
    cases[5] = views(5, 1500, 500, 5)  # larger than the pool
    rows = [r for c in cases.values() for r in c[0]]
    rng = np.random.default_rng(9)
    rows += [(6, k, *map(float, rng.uniform(-0.4, 0.4, 4))) for k in range(40)]  # no common scene
    rows += views(7, 7, 0, 7)[0]  # too few
    rows += [(None, 1, 0.1, 0.1, 0.1, 0.1), (0, 9000, None, 0.1, 0.1, 0.1), (0, 9001, float("nan"), 0.1, 0.1, 0.1), (0, 9002, 0.1, float("inf"), 0.1, 0.1)]
    pairs = spark.createDataFrame(rows, COLS).withColumn("e", F.lit("clash")).withColumn("n", F.lit(0))
    return cases, pairs, T.relative_poses(pairs, "pair", "kp", 1e-6).cache()


def test_true_poses_come_back_with_a_third_of_outliers(solved):
    cases, _, res = solved
    got = {r.pair: r for r in res.collect()}
    assert set(got) == {*cases, 6}
    for p, (rows, rot, t) in cases.items():
        r = got[p]
        assert r.ok and r.confident and r.n == len(rows)
        assert r.inliers == r.front == len(rows) * 2 // 3
        np.testing.assert_allclose(quat_matrix(r.quat), rot, atol=1e-6)
        np.testing.assert_allclose([r.dir.x, r.dir.y, r.dir.z], t, atol=1e-5)
    assert not got[6].ok


def test_counters_count_solved_pairs_only(solved):
    cases, pairs, res = solved
    got = {r.kp: r for r in T.keypoint_counters(pairs, res, "pair", "kp", 1e-6).collect()}
    assert (got[0].total_count, got[0].inlier_count, got[0].inlier_in) == (6, 0, None)
    assert (got[30].total_count, got[30].inlier_count, got[30].inlier_in) == (6, 5, 4)
    assert (got[9000].total_count, got[9000].inlier_count) == (1, 0)
    assert (got[1400].total_count, got[1400].inlier_count, got[1400].inlier_in) == (1, 1, 5)


def test_empty_table_and_reversed_direction(spark, solved):
    empty = spark.createDataFrame([], COLS)
    assert T.relative_poses(empty, "pair", "kp", 1e-6).count() == 0
    rows, rot, t = solved[0][1]
    back = spark.createDataFrame([(1, k, c, d, a, b) for _, k, a, b, c, d in rows], COLS)
    r = T.relative_poses(back, "pair", "kp", 1e-6).first()
    np.testing.assert_allclose(quat_matrix(r.quat), rot.T, atol=1e-6)
    np.testing.assert_allclose([r.dir.x, r.dir.y, r.dir.z], -rot.T @ t, atol=1e-5)
    r = T.relative_poses(spark.createDataFrame(rows, COLS), "pair", "kp", 1e-6, max_depth=5.0).first()
    assert (r.inliers, r.front, r.ok) == (40, 0, False)


def test_trials_follow_the_share_of_inliers():
    assert T.trials_needed(50, 50, 0.99) == 1
    assert T.trials_needed(25, 50, 0.99) > T.trials_needed(40, 50, 0.99) > 1
    e = T._essentials(*(np.random.default_rng(0).uniform(-1, 1, (2, 3, 8, 3))))
    np.testing.assert_allclose(np.linalg.svd(e)[1], [[1, 1, 0]] * 3, atol=1e-9)


def test_pair_coordinates_are_worked_out_once(spark):
    """Filters on the coordinates repeated their whole expressions, until the compiled code was too long to run fast."""
    from types import SimpleNamespace

    from navlytics.workload.refinement import view_pairs

    t = SimpleNamespace(lineitem=spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "l_suppkey long, l_partkey long"),
                        part=spark.createDataFrame([(1, 3, 901.0), (2, 4, 902.5)], "p_partkey long, p_size int, p_retailprice double"))
    rows = view_pairs(t).where(" AND ".join(f"abs({c}) < double('infinity')" for c in ("x0", "y0", "x1", "y1")))
    assert rows.count() == 3
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pmod(hash(") <= 2 and plan.count("quat#") < 60


def test_depths_keep_their_values(spark):
    rows = [(0.1, 0.2, 1.0, 0.3, -0.1, 1.0, 1.0, 0.0, 0.0), (0.1, 0.2, 0.1, 0.2, 1.0, 1.0, 0.0, 0.0, 1.0), (0.1, None, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0)]
    d = spark.createDataFrame(rows, "x1 double, y1 double, a0 double, a1 double, a2 double, t0 double, t1 double, t2 double, k double")
    got = T.with_depths(d, ["a0", "a1", "a2"], ["t0", "t1", "t2"], "z0", "z1").collect()
    for r, x in zip(rows, got):
        if r[1] is None or r[0] == r[2]:  # without a value, without parallax
            assert x.z0 is None and x.z1 is None
            continue
        seen, ray, t = np.array([r[0], r[1], 1.0]), np.array(r[2:5]), np.array(r[5:8])
        c = np.cross(seen, ray)
        assert np.isclose(x.z0, -np.cross(seen, t) @ c / (c @ c)) and np.isclose(x.z1, -np.cross(ray, t) @ c / (c @ c))
    assert set(got[0].asDict()) == {*d.columns, "z0", "z1"}
