"""Cases that once lost rows."""

from pyspark.sql import functions as F

from navlytics.operators.nearest import knn_join
from navlytics.plans.mapping import batch_membership, classify_landmarks
from navlytics.sources.telemetry import frame_number


def test_long_frame_numbers(spark):
    df = spark.createDataFrame([("/a/img1607000000000000.png",), ("/a/notes.txt",)], "p string")
    assert [r[0] for r in df.select(frame_number(F.col("p"))).collect()] == [1607000000000000, None]


def test_knn_leaves_out_nan_and_null(spark):
    nan = float("nan")
    needles = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 5.0]), (3, [nan, 1.0])], "n long, v array<double>")
    hay = spark.createDataFrame([(1, [1.0, 2.0]), (2, [nan, 0.0]), (3, [4.0, 4.0]), (4, None)], "h long, v array<double>")
    got = knn_join(needles, hay, "n", "h", "v", 1).collect()
    assert sorted((r.n, r.hay_id) for r in got) == [(1, 1), (2, 3)]


def test_batches_beyond_one_word(spark):
    obs = spark.createDataFrame([(1, 6), (1, 70), (2, 3), (2, 3)], "p long, b long")
    got = batch_membership(obs, "p", "b", spark.createDataFrame([(70,), (70,)], "b long")).collect()
    assert sorted((r.p, r.word, r.bits, r.batches, r.frozen) for r in got) == [(1, 0, 1 << 6, 2, True), (1, 1, 1 << 10, 2, True), (2, 0, 1 << 3, 1, False)]
    assert not any(r.frozen for r in batch_membership(obs, "p", "b").collect())


def test_landmark_behind_a_camera_waits(spark):
    """It gets no error flag, and its errors do not widen the limits of the frame."""
    rows = [(1, 1, -1.0, 50.0, 0.0), (2, 1, 1.0, 0.1, 0.0), (3, 1, 1.0, 9.0, 0.0), *((10 + k, 1, 1.0, 0.0, 0.0) for k in range(20)), (4, 2, -1.0, 0.0, 0.0)]
    obs = spark.createDataFrame(rows, "kp long, f long, z double, ex double, ey double")
    got = {r.kp: r.verdict for r in classify_landmarks(obs, "kp", "f", "z", "ex", "ey", 800.0).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("wait", "good", "remove", "wait")
    calm = classify_landmarks(obs, "kp", "f", "z", "ex", "ey", 800.0, votes=F.col("f") == 2).collect()
    assert {r.kp: r.verdict for r in calm}[3] == "good"


def test_infinite_components_lose_no_match(spark):
    from navlytics.operators.nearest import knn_join

    needles = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 5.0])], "n long, v array<double>")
    for odd in (2, 5, 7):
        hay = spark.createDataFrame([(odd, [float("inf"), 0.0]), (3 if odd != 3 else 9, [1.0, 2.0]), (4, [4.0, 4.0])], "h long, v array<double>")
        got = {r.n: r.hay_id for r in knn_join(needles, hay, "n", "h", "v").collect()}
        assert got == {1: 3, 2: 4}


def test_rows_before_the_first_knot_without_keys(spark):
    from navlytics.sources.telemetry import cubic_at

    knots = spark.createDataFrame([(float(t), 2.0 * t) for t in range(1, 6)], "kt double, kv double")
    rows = spark.createDataFrame([(1, 0.0), (2, 2.5), (3, 7.0)], "i long, x double")
    got = {r.i: r.interp for r in cubic_at(rows, knots, [], "x", "kt", "kv", "i").collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in ((1, 0.0), (2, 5.0), (3, 14.0)))


def test_pixels_of_very_wide_images_keep_apart(spark):
    """The last column of a row over a million pixels wide is another pixel than the first of the next row."""
    from navlytics.operators.raster import bilinear_or_nearest

    pixels = spark.createDataFrame([(1, 0, 1_000_000, 5.0), (1, 1, 0, 7.0)], "img int, row int, col int, v double")
    points = spark.createDataFrame([(1, 10, 1_000_002.5, 0.0), (1, 11, 0.0, 3.5)], "img int, id int, x double, y double")
    got = {r.id: r.interp for r in bilinear_or_nearest(points, pixels, ["img"], "x", "y", "v", "id", 4.0).collect()}
    assert got == {10: 5.0, 11: 7.0}


def test_masked_matches_leave_out_vectors_without_a_distance(spark):
    """Null vectors and components ended the masked matches."""
    from navlytics.plans import matching

    kind = "long, v array<double>, x double, y double"
    a = spark.createDataFrame([(1, [0.0] * 8, 1.0, 1.0), (2, None, 1.0, 1.0), (3, [None] + [0.0] * 7, 1.0, 1.0)], "a " + kind)
    b = spark.createDataFrame([(4, [1.0] * 8, 1.0, 1.0), (5, None, 1.0, 1.0), (6, [0.5] * 8, 9.0, 9.0)], "b " + kind)
    for got in (matching.spatial_match(a, b, "a", "b", "v", "x", "y", 2.0), matching.banded_match(a, b, "a", "b", "v", "x", "x", 0.0, 2.0)):
        assert [(r.a, r.b) for r in got.collect()] == [(1, 4)]


def test_match_masks_send_keypoints_to_one_tile(spark, tmp_path):
    """every scene keypoint was repeated for nine cells."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    rows = [(i * 7 % 601, i * 13 % 997, 1 + i % 3, float(i % 50)) for i in range(2500)]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries()["match_mask_counts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(oracle_sql()["match_mask_counts"]).fetchall()}
    assert want and {(r.img, r.id, r.n) for r in got.collect()} == want
    assert "explode(array(" not in got._jdf.queryExecution().optimizedPlan().toString()
