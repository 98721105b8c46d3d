"""Descriptor matching, nearest lookups and cross-batch tracks on the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from navlytics.operators import nearest as N
from navlytics.plans import matching as M
from navlytics.workload.base import frames, query, rnd

_AB = """WITH a AS (SELECT vec_id AS a, embedding::DOUBLE[] AS e, label, 1.0 + (vec_id * 7 % 40) / 10.0 AS sc, vec_id * 37 % 640 AS x, vec_id * 53 % 480 AS y FROM embeddings WHERE label < 5),
b AS (SELECT vec_id AS b, embedding::DOUBLE[] AS f, label, 1.0 + (vec_id * 7 % 40) / 10.0 AS sc, vec_id * 37 % 640 AS x, vec_id * 53 % 480 AS y FROM embeddings WHERE label >= 5)"""
_D = _AB + ", d AS (SELECT a, b, list_distance(e, f) AS d FROM a, b)"


def sides(t):
    v = F.col("vec_id")
    e = t.embeddings.select("vec_id", "embedding", "label", (1.0 + (v * 7 % 40) / 10.0).alias("scale"),
                            (v * 37 % 640).cast("double").alias("x"), (v * 53 % 480).cast("double").alias("y"))
    return e.where("label < 5").withColumnRenamed("vec_id", "a"), e.where("label >= 5").withColumnRenamed("vec_id", "b")


@query(_D + " SELECT a, b, round(d, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r = 1")
def nn_per_needle(t):
    a, b = sides(t)
    return N.knn_join(a, b, "a", "b", "embedding").select("a", F.col("hay_id").alias("b"), F.round("score", 5).alias("score"))


@query(_AB + ", d AS (SELECT a, b, list_max(list_transform(range(1,65), lambda i: abs(e[i]-f[i]))) AS d FROM a, b) SELECT a, b, round(d, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r = 1")
def nn_chebyshev(t):
    a, b = sides(t)
    return N.knn_join(a, b, "a", "b", "embedding", metric="linf").select("a", F.col("hay_id").alias("b"), F.round("score", 5).alias("score"))


@query(_D + """, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM d)
SELECT a, b, round(d, 5) AS score FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nn_match(t):
    a, b = sides(t)
    return N.mutual_nearest(a, b, "a", "b", "embedding").select("a", "b", F.round("score", 5).alias("score"))


@query(_D + """, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS d2 FROM d)
SELECT a, b, round(d, 5) AS d1, round(d2, 5) AS d2 FROM r WHERE ra = 1 AND d < 0.95 * d2""")
def lowe_ratio_match(t):
    a, b = sides(t)
    m = N.lowe_ratio(a, b, "a", "b", "embedding", 0.95)
    return m.select("a", F.col("hay_id").alias("b"), F.round("d1", 5).alias("d1"), F.round("d2", 5).alias("d2"))


_BITS = "list_sum(list_transform(range(1,65), lambda i: CASE WHEN (e[i] > 0) <> (f[i] > 0) THEN 1 ELSE 0 END))"


@query(_AB + f", d AS (SELECT a, b, {_BITS} AS d FROM a, b) SELECT a, b, CAST(d AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r = 1")
def hamming_match(t):
    """Packed binary descriptors (signs of the components) under the Hamming metric."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    packed = F.unhex(F.concat(*[F.lpad(F.conv(F.substring(bits, 1 + 16 * i, 16), 2, 16), 4, "0") for i in range(4)]))
    a, b = (s.withColumn("desc", packed) for s in sides(t))
    return N.knn_join(a, b, "a", "b", "desc", metric="hamming").select("a", F.col("hay_id").alias("b"), "score")


@query(_AB + """, d AS (SELECT a, b, list_distance(e, f) AS d FROM a JOIN b ON sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) < 150),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM d) SELECT a, b, round(d, 5) AS score FROM r WHERE ra = 1 AND rb = 1""")
def spatial_masked_match(t):
    a, b = sides(t)
    return M.spatial_match(a, b, "a", "b", "embedding", "x", "y", 150.0).select("a", "b", F.round("score", 5).alias("score"))


@query()
def scale_restricted_match(t):
    a, b = sides(t)
    return M.scale_restricted(a, b, "a", "b", "embedding", "scale").select("a", "b", F.round("score", 5).alias("score"))


@query(_AB + """, d AS (SELECT a, b, list_distance(e, f) AS d FROM a JOIN b ON abs(ln(a.sc) + 0.1 - ln(b.sc)) < 0.25),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM d) SELECT a, b, round(d, 5) AS score FROM r WHERE ra = 1 AND rb = 1""")
def banded_scale_match(t):
    a, b = sides(t)
    m = M.banded_match(a.withColumn("p", F.log("scale")), b.withColumn("q", F.log("scale")), "a", "b", "embedding", "p", "q", 0.1, 0.25)
    return m.select("a", "b", F.round("score", 5).alias("score"))


@query("""WITH RECURSIVE a AS (SELECT vec_id AS a, embedding::DOUBLE[] AS e, label FROM embeddings), d AS (SELECT x.a AS a, y.a AS b, row_number() OVER (PARTITION BY x.a ORDER BY list_distance(x.e, y.e), y.a) AS r
 FROM a x JOIN a y ON (x.label < 5) <> (y.label < 5)), e AS (SELECT a, b FROM d WHERE r = 1 UNION SELECT b, a FROM d WHERE r = 1),
c AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node)
SELECT node AS feature, min(root) AS track_id FROM c GROUP BY 1""")
def track_components(t):
    """Features linked by nearest matches in both directions between the two halves."""
    a, b = sides(t)
    f = N.knn_join(a, b, "a", "b", "embedding").select("a", F.col("hay_id").alias("b"))
    g = N.knn_join(b, a, "b", "a", "embedding").select(F.col("hay_id").alias("a"), "b")
    return M.assign_tracks(f.unionByName(g), "a", "b")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey % 2 AS s, CAST(o_orderkey % 41 - 20 AS DOUBLE) AS x, CAST(o_custkey % 37 - 18 AS DOUBLE) AS y, CAST(o_orderkey % 7 AS DOUBLE) AS z FROM orders),
g AS (SELECT x, y, z, min(id) AS id FROM f WHERE s = 1 GROUP BY ALL), u AS (SELECT DISTINCT x, y, z FROM f WHERE s = 0),
n AS (SELECT u.x, u.y, u.z, g.id, row_number() OVER (PARTITION BY u.x, u.y, u.z ORDER BY pow(u.x-g.x,2)+pow(u.y-g.y,2)+pow(u.z-g.z,2), g.id) AS r, sqrt(pow(u.x-g.x,2)+pow(u.y-g.y,2)+pow(u.z-g.z,2)) AS d FROM u, g)
SELECT f.id AS f0, n.id AS f1, round(d, 5) AS dist FROM f JOIN n USING (x, y, z) WHERE s = 0 AND r = 1""")
def nearest_frame_cross_batch(t):
    """Nearest frame of the other batch by camera location."""
    f = frames(t).select("frame_id", "session", F.array("loc.x", "loc.y", "loc.z").alias("p"))
    a = f.where("session % 2 = 0").select(F.col("frame_id").alias("f0"), "p")
    b = f.where("session % 2 = 1").select(F.col("frame_id").alias("f1"), "p")
    return N.knn_join(a, b, "f0", "f1", "p").select("f0", F.col("hay_id").alias("f1"), F.round("score", 5).alias("dist"))


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS f, l_partkey // 4 AS tr FROM lineitem), n AS (SELECT f, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT a.f AS fa, b.f AS fb, count(*) AS common FROM o a JOIN o b ON a.tr = b.tr WHERE a.f % 2 = 0 AND b.f % 2 = 1 GROUP BY 1, 2),
l AS (SELECT fa, fb, common, x.n + y.n - 2 * common AS l1 FROM c JOIN n x ON x.f = fa JOIN n y ON y.f = fb)
SELECT fa, fb, common, CAST(l1 AS DOUBLE) AS l1 FROM (SELECT *, row_number() OVER (PARTITION BY fa ORDER BY l1, fb) AS r FROM l) WHERE r = 1 AND common >= 15""")
def shared_track_pairs(t):
    o = t.lineitem.select(F.col("l_suppkey").alias("f"), F.floor(F.col("l_partkey") / 4).alias("tr"))
    s = t.supplier.select(F.col("s_suppkey").alias("f"))
    return M.shared_tracks(o, "f", "tr", s.where("f % 2 = 0"), s.where("f % 2 = 1"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size * 10.0 AS x, p_retailprice / 2 AS y FROM part), q AS (SELECT o_orderkey AS id, o_custkey % 500 AS x, o_orderkey % 499 AS y FROM orders),
n AS (SELECT q.id AS c, min(greatest(abs(p.x - q.x), abs(p.y - 400 - q.y))) AS d FROM q, p GROUP BY 1)
SELECT c FROM n WHERE d >= 8 ORDER BY c LIMIT 300""")
def new_corner_candidates(t):
    p = t.part.select(F.col("p_partkey").alias("e"), F.array(F.col("p_size") * 10.0, F.col("p_retailprice") / 2 - 400).alias("v"))
    q = t.orders.select(F.col("o_orderkey").alias("c"), F.array((F.col("o_custkey") % 500).cast("double"), (F.col("o_orderkey") % 499).cast("double")).alias("v"), F.lit(0).alias("response"))
    return M.new_corners(q, p, "c", "e", "v", 8.0, "response", 300).select("c")


@query("""WITH t AS (SELECT p_partkey AS id, p_size * 9.0 AS x, p_partkey % 97 * 5.0 AS y FROM part), c AS (SELECT c_custkey AS id, c_custkey % 451 AS x, c_custkey % 487 AS y FROM customer),
d AS (SELECT t.id AS a, c.id AS b, sqrt(pow(t.x-c.x,2)+pow(t.y-c.y,2)) AS d FROM t, c), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM d)
SELECT t.id, r.a IS NOT NULL AS snapped, CASE WHEN r.a IS NOT NULL THEN CAST(c.x AS DOUBLE) ELSE t.x END AS x FROM t LEFT JOIN (SELECT * FROM r WHERE ra = 1 AND rb = 1 AND d <= 20) r ON r.a = t.id LEFT JOIN c ON c.id = r.b""")
def snap_to_corner(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") * 9.0, F.col("p_partkey") % 97 * 5.0).alias("v"))
    c = t.customer.select(F.col("c_custkey").alias("cid"), F.array((F.col("c_custkey") % 451).cast("double"), (F.col("c_custkey") % 487).cast("double")).alias("v"))
    return M.snap(p, c, "id", "cid", "v", 20.0).select("id", "snapped", F.col("v")[0].alias("x"))


@query("""SELECT event_id, value FROM events ORDER BY abs(value - 77.7), event_id LIMIT 1""")
def nearest_value(t):
    return M.nearest_value(t.events, "event_id", "value", 77.7)


@query("""WITH c AS (SELECT embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_distance(embedding::DOUBLE[], c), 5) AS dist FROM embeddings, c WHERE list_distance(embedding::DOUBLE[], c) < 1.3""")
def radius_search(t):
    target = [float(x) for x in t.embeddings.where("vec_id = 7").first()["embedding"]]
    return M.within_radius(t.embeddings, "embedding", target, 1.3).select("vec_id", F.round("dist", 5).alias("dist"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS i, round(sqrt(pow(p_size - i * 10, 2) + pow(p_retailprice / 10 - i * 20, 2)), 5) AS d FROM part, range(5) r(i)""")
def anchor_distances(t):
    d = t.part.select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 10).alias("v"))
    d = M.anchor_distances(d, "v", [[i * 10.0, i * 20.0] for i in range(5)])
    return d.select("p_partkey", F.posexplode("dists").alias("i", "d")).withColumn("d", F.round("d", 5))


@query("""WITH g AS (SELECT value, count(*) AS n, lag(value) OVER (ORDER BY value) AS p FROM events GROUP BY value), c AS (SELECT *, sum(CASE WHEN value - p >= 0.5 THEN 1 ELSE 0 END) OVER (ORDER BY value) AS grp FROM g)
SELECT CAST(grp AS BIGINT) AS grp, round(sum(value * n) / sum(n), 5) AS level, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def grouped_levels(t):
    return M.grouped_levels(t.events, "value", 0.5).withColumn("level", F.round("level", 5))


@query("""WITH b AS (SELECT DISTINCT label FROM embeddings) SELECT x.label AS batch1, y.label AS batch2 FROM b x JOIN b y ON x.label < y.label WHERE NOT (x.label = 0 AND y.label % 2 = 1)""")
def unprocessed_batch_pairs(t):
    done = t.embeddings.where("label % 2 = 1").select(F.lit(0).alias("batch1"), F.col("label").alias("batch2")).distinct()
    return M.batch_pairs(t.embeddings, "label", done)


@query("SELECT o_orderkey AS f0, o_orderkey + 5 AS f1 FROM orders WHERE o_orderkey % 10 = 0 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = orders.o_orderkey + 5)")
def frame_pairing(t):
    return M.frame_pairs(t.orders, "o_orderkey", 10, 5)


@query("""SELECT vec_id, round(sqrt(abs(e) / sum(abs(e)) OVER (PARTITION BY vec_id)), 5) AS r, i - 1 AS i FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def root_sift(t):
    d = t.embeddings.select("vec_id", M.root_sift(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("r"))
    return d.select("vec_id", F.posexplode("r").alias("i", "r")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("r", 5).alias("r"))


@query(_D + ", r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) SELECT a, round(sum(exp(-0.5*d*d) * (b % 10)) / sum(exp(-0.5*d*d)), 5) AS interp FROM r WHERE r <= 3 GROUP BY 1")
def kernel_knn_interpolation(t):
    a, b = sides(t)
    m = M.kernel_interpolate(a, b.withColumn("val", F.col("b") % 10), "a", "b", "embedding", "val", 3, 1.0)
    return m.withColumn("interp", F.round("interp", 5))
