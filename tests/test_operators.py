"""Operators against brute force, with hot keys and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navlytics.operators import nearest, raster
from navlytics.operators.graph import connected_components
from navlytics.operators.ordered import Ordered, asof_backward, dense_ids
from navlytics.operators.quantiles import exact_quantiles
from navlytics.operators.skew import heavy_keys, salted_lookup
from navlytics.operators.spatial import _around, keep_spaced, suppress_greedy
from navlytics.plans import matching


def test_ordered_with_hot_key_and_tied_times(spark):
    rng = np.random.default_rng(0)
    n = 3000
    p = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n)), "t": np.where(rng.random(n) < 0.4, 50, rng.integers(0, 100, n)),
                      "id": np.arange(n), "v": rng.integers(0, 100, n).astype(float)})
    p.loc[rng.random(n) < 0.3, "v"] = np.nan
    d = spark.createDataFrame(p).withColumn("v", F.nanvl("v", F.lit(None)))
    o = Ordered(d, ["k"], "t", "id", 16).prefix(lag={"a": F.col("v")}, lead={"b": F.col("id")}, total={"s": F.col("v")}, last={"l": F.col("v")}, high={"h": F.col("v")}, rank="r")
    got = o.toPandas().sort_values("id").reset_index(drop=True)
    q = p.sort_values(["k", "t", "id"])
    g = q.groupby("k")
    q = q.assign(a=g.v.shift(1), b=g.id.shift(-1), s=g.v.transform(lambda x: x.fillna(0).cumsum().where(x.notna().cummax())), l=g.v.ffill(), h=g.v.transform(lambda x: x.expanding().max()), r=g.cumcount() + 1)
    q = q.sort_values("id").reset_index(drop=True)
    for c in "absl hr".replace(" ", ""):
        np.testing.assert_allclose(got[c].astype(float), q[c].astype(float), err_msg=c)


def test_heavy_ties_are_cut_along_the_tiebreak(spark):
    d = spark.range(1000).select(F.lit(5).alias("t"), "id")
    o = Ordered(d, [], "t", "id", 8)
    assert o.df.groupBy("__slice").count().agg(F.max("count")).first()[0] < 300
    assert dense_ids(d, "t", tie="id").where("dense_id <> id").count() == 0


def test_asof_backward(spark):
    left = spark.createDataFrame([(1, 10, 5.0), (1, 11, 1.0), (2, 12, 3.0)], "k long, id long, t double")
    right = spark.createDataFrame([(1, 2.0, "a"), (1, 5.0, "b"), (2, 4.0, "c")], "k long, rt double, p string")
    got = {r.id: r.p for r in asof_backward(left, right, ["k"], "t", "rt", "id", ["p"]).collect()}
    assert got == {10: "b", 11: None, 12: None}


def test_quantiles_beyond_the_small_group_path(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 25000), np.full(15000, 0.25), rng.lognormal(0, 3, 5000)])
    d = spark.createDataFrame(pd.DataFrame({"g": 1, "v": v}))
    probs = {"a": 0.0, "b": 0.159, "c": 0.5, "d": 0.977, "e": 1.0}
    r = exact_quantiles(d, ["g"], "v", probs).first()
    np.testing.assert_allclose([r[k] for k in probs], np.quantile(v, list(probs.values())), rtol=1e-12)
    r = exact_quantiles(d, [], "v", probs).first()
    np.testing.assert_allclose([r[k] for k in probs], np.quantile(v, list(probs.values())), rtol=1e-12)


def test_salted_lookup_equals_plain_join(spark):
    big = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    small = big.select("k").distinct().withColumn("x", F.col("k") * 2)
    hot = heavy_keys(big, "k", 0.01)
    assert hot == [7]
    a = salted_lookup(big, small, "k", heavy=hot)
    assert a.agg(F.count("*"), F.sum("x")).first() == big.join(small, "k").agg(F.count("*"), F.sum("x")).first()


@pytest.mark.parametrize("metric", ["l2", "l1", "linf", "hamming"])
def test_knn_join_is_exact_with_clusters_and_copies(spark, metric):
    rng = np.random.default_rng(2)
    if metric == "hamming":
        mk = lambda n: [bytes(r) for r in rng.integers(0, 256, (n, 8)).astype(np.uint8)]
    else:
        mk = lambda n: [list(map(float, r)) for r in np.vstack([rng.normal(rng.integers(0, 4) * 10, 0.3, (n - n // 3, 3)), np.ones((n // 3, 3))])]
    a, b = mk(60), mk(90)
    t = "binary" if metric == "hamming" else "array<double>"
    da = spark.createDataFrame(list(enumerate(a)), f"a long, v {t}")
    db = spark.createDataFrame(list(enumerate(b)), f"b long, v {t}")
    got = nearest.knn_join(da, db, "a", "b", "v", 2, metric, pivots=6, block_rows=20).toPandas().sort_values(["a", "rank"])
    d = nearest.pair_distances(nearest.stack(pd.Series(a), metric), nearest.stack(pd.Series(b), metric), metric)
    want = np.argsort(d, axis=1, kind="stable")[:, :2]
    np.testing.assert_array_equal(got.hay_id.to_numpy().reshape(-1, 2), want)


def test_knn_join_collapses_piles_of_copies(spark):
    p = [[float(i % 7), 0.0] if i % 3 else [1.0, 1.0] for i in range(4500)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "a long, v array<double>")
    got = nearest.knn_join(d, d.withColumnRenamed("a", "b"), "a", "b", "v", 2, pivots=4, block_rows=500)
    bad = got.where("score <> 0").count()
    assert got.count() == 9000 and bad == 0
    assert {r.hay_id for r in got.where("a % 3 = 0").select("hay_id").distinct().collect()} == {0, 3}


def _crowd(n=400):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"img": 0, "x": rng.uniform(0, 100, n), "y": rng.uniform(0, 100, n), "o": np.arange(n)})
    p.loc[: n // 3, ["x", "y"]] = [50.0, 50.0]
    return p, np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values)


def test_keep_spaced(spark):
    p, d = _crowd()
    want = [i for i in range(len(p)) if (d[i, :i] > 7).all()]
    assert sorted(keep_spaced(spark.createDataFrame(p), ["img"], "x", "y", "o", 7.0).toPandas().o) == want


def test_suppress_greedy(spark):
    p, d = _crowd(150)
    alive, want = np.ones(len(p), bool), []
    for i in range(len(p)):
        if alive[i]:
            want.append(i)
            alive &= ~(d[i] < 9)
    assert sorted(suppress_greedy(spark.createDataFrame(p), ["img"], "x", "y", "o", 9.0).toPandas().o) == want


def test_representatives_go_to_few_tiles(spark):
    """every point used to be sent to 24 neighbour cells."""
    cells = spark.range(-32, 32).select(F.col("id").alias("__cx")).crossJoin(spark.range(-32, 32).select(F.col("id").alias("__cy")))
    got = _around(cells).toPandas()
    assert len(got) < 2.5 * 64 * 64 and got.groupby(["__cx", "__cy"]).size().max() <= 4
    tiles = set(got.itertuples(index=False, name=None))
    assert all((x, y, (x + i) >> 3, (y + j) >> 3) in tiles for x in range(-32, 32, 5) for y in range(-32, 32) for i in (-2, 2) for j in (-2, 2))


def test_spacing_in_a_crowded_tile(spark):
    """Thousands of places in one tile, whose rows are dealt by salts."""
    rng = np.random.default_rng(11)
    n = 2500
    p = pd.DataFrame({"img": 1, "x": rng.uniform(0, 30, n), "y": rng.uniform(-3, 27, n), "o": rng.permutation(n)}).sort_values("o").reset_index(drop=True)
    d = np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values)
    want = [i for i in range(n) if (d[i, :i] > 0.7).all()]
    df = spark.createDataFrame(p)
    assert heavy_keys(df.withColumn("k", F.lit(1)), "k")
    assert sorted(keep_spaced(df, ["img"], "x", "y", "o", 0.7).toPandas().o) == want
    big = [i for i in range(n) if (d[i, :i] > 6.0).all()]
    assert sorted(keep_spaced(df, ["img"], "x", "y", "o", 6.0).toPandas().o) == big
    alive, want = np.ones(n, bool), []
    for i in range(n):
        if alive[i]:
            want.append(i)
            alive &= ~(d[i] < 6.0)
    assert sorted(suppress_greedy(df, ["img"], "x", "y", "o", 6.0).toPandas().o) == want


def test_suppression_ends_with_rows_without_a_place(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1), (1, 2.0, 1.0, 2), (1, None, 1.0, 3), (1, 50.0, 1.0, None), (None, 90.0, 1.0, 5)], "img long, x double, y double, o long")
    assert [r.o for r in suppress_greedy(df, ["img"], "x", "y", "o", 9.0).collect()] == [1]


def test_components_with_a_hub_and_a_chain(spark):
    e = [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(10)] + [(50, 50)]
    got = connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").toPandas().set_index("node").component.to_dict()
    assert got == {**{i: 100 for i in range(100, 130)}, **{i: 0 for i in range(11)}, 50: 50}


def test_shared_tracks_with_wide_tracks(spark):
    rng = np.random.default_rng(4)
    rows = {(int(f), int(t)) for f in range(24) for t in np.r_[rng.choice(40, 12), [900, 901], ([902] if f % 2 else [])]} | {(30, 900), (31, 901), (31, 900)}
    o = spark.createDataFrame(sorted(rows), "f long, t long")
    frames = o.select("f").distinct()
    a, b = frames.where("f % 2 = 0"), frames.where("f % 2 = 1")
    sets = {}
    for f, t in rows:
        sets.setdefault(f, set()).add(t)
    want = {}
    for fa in (f for f in sets if f % 2 == 0):
        l1, fb = min((len(sets[fa] ^ sets[x]), x) for x in sets if x % 2)
        if len(sets[fa] & sets[fb]) >= 2:
            want[fa] = (fb, len(sets[fa] & sets[fb]), float(l1))
    for wide in (3, 1000):
        got = {r.fa: (r.fb, r.common, r.l1) for r in matching.shared_tracks(o, "f", "t", a, b, 2, wide).collect()}
        assert got == want


def test_common_tracks_are_counted_without_shuffling_pairs(spark):
    """every pair of frames of every track used to be dealt by pair."""
    rng = np.random.default_rng(8)
    a, b = ({(int(f), int(t)) for f, t in zip(rng.integers(0, 60, 900) * 2 + s, rng.integers(0, 50, 900))} for s in (0, 1))
    want = {}
    for f, t in a:
        for g, u in b:
            if t == u:
                want[f, g] = want.get((f, g), 0) + 1
    got = matching._common_tracks(spark.createDataFrame(sorted(a), "fa long, t long"), spark.createDataFrame(sorted(b), "fb long, t long"), "t")
    assert {(r.fa, r.fb): r.c for r in got.collect()} == want and dict(got.dtypes)["fb"] == "bigint"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")]
    # a frame with most rows is dealt by track, and ids beyond 32 bits stay whole
    hub = {(0, t) for t in range(3000)} | {(2, 1)}
    got = matching._common_tracks(spark.createDataFrame(sorted(hub), "fa long, t long"), spark.createDataFrame([(2**40 + 1, t) for t in range(0, 3000, 2)] + [(7, 1)], "fb long, t long"), "t")
    assert {(r.fa, r.fb): r.c for r in got.collect()} == {(0, 2**40 + 1): 1500, (0, 7): 1, (2, 7): 1}


def test_scale_restricted_finds_the_common_scale(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (30, 6))
    sa = rng.uniform(1, 8, 30)
    a = spark.createDataFrame([(i, list(map(float, v[i])), float(sa[i])) for i in range(30)], "a long, v array<double>, s double")
    b = spark.createDataFrame([(i, list(map(float, v[i] + 0.01)), float(sa[i] * (2.0 if i < 25 else 5.0))) for i in range(30)], "b long, v array<double>, s double")
    got = {(r.a, r.b) for r in matching.scale_restricted(a, b, "a", "b", "v", "s").collect()}
    assert {(i, i) for i in range(25)} <= got and not any((i, i) in got for i in range(25, 30))


def test_box_sums_mirror_border(spark):
    img = np.arange(20.0).reshape(4, 5)
    d = spark.createDataFrame([(0, r, c, float(img[r, c])) for r in range(4) for c in range(5)], "img int, row int, col int, v double")
    got = raster.box_sums(d, ["img"], "v", 3, 4, 5, mirror=True).toPandas().sort_values(["row", "col"])
    pad = np.pad(img, 1, mode="reflect")
    want = sum(pad[i : i + 4, j : j + 5] for i in range(3) for j in range(3))
    np.testing.assert_allclose(got.s.to_numpy().reshape(4, 5), want)
    assert (got.n == 9).all()


def test_affine_scan_equals_a_loop(spark):
    import random

    from navlytics.operators.ordered import affine_scan

    rnd = random.Random(2)
    rows = [(k, t, i, rnd.choice([0.0, 1.0, -0.5, 0.9, None]), rnd.choice([rnd.uniform(-1, 1), None])) for i, (k, t) in enumerate((k, t // 2) for k in (1, 2, 3) for t in range(20 if k == 3 else 130))]
    want, y = {}, {}
    for k, t, i, a, b in sorted(rows):
        y[k] = y.get(k, 0.0) if a is None or b is None else a * y.get(k, 0.0) + b
        want[i] = y[k]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "k long, t long, i long, a double, b double")
    got = {r.i: r.y for r in affine_scan(df, ["k"], "t", "i", F.col("a"), F.col("b"), "y", n=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert affine_scan(df.limit(0), ["k"], "t", "i", F.col("a"), F.col("b"), "y", n=5).count() == 0


@pytest.mark.parametrize("metric", ["l1", "l2", "linf"])
def test_tree_cells_find_what_brute_force_finds(spark, monkeypatch, metric):
    """few components go by a tree of many leaves; one column of equal values and copies among them."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    rng = np.random.default_rng(3)
    b = rng.integers(0, 30, (700, 3)).astype(float)
    b[:200, 0] = 7.0
    a = np.vstack([rng.integers(-40, 60, (150, 3)), b[:50]]).astype(float)
    da = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "a long, v array<double>")
    db = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "b long, v array<double>")
    got = nearest.knn_join(da, db, "a", "b", "v", 3, metric).toPandas().sort_values(["a", "rank"])
    d = nearest.pair_distances(a, b, metric)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got["hay_id"].to_numpy().reshape(-1, 3).tolist() == want.tolist()


def test_products_rank_as_measured_distances():
    """Blocks of long vectors are ranked by products, near ties and copies as by the distances themselves."""
    rng = np.random.default_rng(4)
    y = rng.normal(size=(300, 64)) + 1000.0
    y[100:200] = y[:100]
    x = np.vstack([y[:40], y[40:80] + 1e-9, rng.normal(size=(40, 64))])
    d = nearest.pair_distances(x, y, "l2")
    apart = np.arange(len(y))[None] % 3 == np.arange(len(x))[:, None] % 3
    for k in (1, 2, 7):
        for mask in (None, apart):
            masked = d if mask is None else np.where(mask, np.inf, d)
            r, c, v = nearest.nearest_pairs(x, y, "l2", k, None if mask is None else lambda s: mask[s])
            want = np.argsort(masked, axis=1, kind="stable")[:, :k]
            assert (r == np.repeat(np.arange(len(x)), k)).all()
            np.testing.assert_allclose(v.reshape(-1, k), np.take_along_axis(masked, want, 1), rtol=1e-9, atol=1e-12)
            assert (c.reshape(-1, k) == want).mean() > 0.99


def test_snap_broadcasts_no_table(spark):
    """corners and tracks may be as many as the rows, however small their files."""
    p = spark.range(40).select("id", F.array((F.col("id") * 3 % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("v"))
    out = matching.snap(p, p.withColumnRenamed("id", "cid"), "id", "cid", "v", 1.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("strategy=merge" in line for line in plan.splitlines() if "Join" in line) >= 3
    assert out.where("snapped").count() == 40  # every spot is its own corner


def test_quantiles_of_few_large_groups_are_spread(spark):
    """rows of a large group are not joined with its limits in one task."""
    from navlytics.operators.quantiles import robust_mean

    d = spark.range(9000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    got = robust_mean(d, ["g"], "v", 10.0)
    assert "__salt" in got._jdf.queryExecution().analyzed().toString()
    p = d.toPandas()
    for r in got.collect():
        v = p.v[p.g == r.g]
        v = v[(v > v.quantile(0.1)) & (v < v.quantile(0.9))]
        assert r.robust_n == len(v) and abs(r.robust_mean - v.mean()) < 1e-9
