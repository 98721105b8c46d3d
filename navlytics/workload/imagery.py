"""Pixel tables, meshes, label files and dataset export."""

from __future__ import annotations

from pyspark.sql import functions as F

from navlytics.functions import vectors as V
from navlytics.operators import raster as X
from navlytics.operators.quantiles import exact_quantiles
from navlytics.sources import dataset as D
from navlytics.sources import labels as L
from navlytics.sources import mesh as M
from navlytics.workload.base import query, rnd

# every embedding is an 8x8 tile; weak components are missing pixels
_PX = "px AS (SELECT vec_id AS img, CAST((i-1)//8 AS INTEGER) AS row, CAST((i-1)%8 AS INTEGER) AS col, CASE WHEN abs(e) > 0.03 THEN e END AS val, e AS raw FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def tiles(t):
    p = t.embeddings.select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    return p.select("img", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.when(F.abs("e") > 0.03, F.col("e")).alias("val"), F.col("e").alias("raw"))


@query(f"WITH {_PX} SELECT a.img, a.row, a.col, round(coalesce(a.val, CASE WHEN count(b.val) > 0.5*9 THEN avg(b.val) END), 6)+0.0 AS val FROM px a JOIN px b ON a.img = b.img AND abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY a.img, a.row, a.col, a.val")
def nan_box_mean(t):
    return X.nan_blur(tiles(t).drop("raw"), ["img"], "val", 3, 8, 8, 0.5).select("img", "row", "col", rnd(F.col("val")).alias("val"))


@query(f"""WITH {_PX}, b AS (SELECT a.img, a.row, a.col, a.val, avg(b.val) AS m FROM px a JOIN px b ON a.img = b.img AND abs(a.row-b.row) <= 2 AND abs(a.col-b.col) <= 2 GROUP BY ALL),
g AS (SELECT a.img, a.row, a.col, 1 - count(b.val)/9.0 AS g FROM px a JOIN px b ON a.img = b.img AND abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY ALL)
SELECT img, row, col, val IS NULL OR (abs(val - m) > 0.15 AND g > 0.2) OR g > 0.7 AS outlier FROM b JOIN g USING (img, row, col)""")
def raster_outliers(t):
    return X.outliers(tiles(t).drop("raw"), ["img"], "val", 8, 8, 5, 3, 0.15).select("img", "row", "col", "outlier")


@query(f"WITH {_PX} SELECT img, count(CASE WHEN row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 THEN val END) AS n FROM px GROUP BY 1")
def border_removal(t):
    return tiles(t).withColumn("v", X.clear_borders("val", 2, 8, 8)).groupBy("img").agg(F.count("v").alias("n"))


@query(f"""WITH {_PX}, k(dr, dc, w) AS (SELECT i, j, exp(-(i*i+j*j)/2.0) FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)), s AS (SELECT sum(w) AS s FROM k)
SELECT a.img, a.row, a.col, round(sum(b.raw * w) / max(s), 6)+0.0 AS conv FROM px a JOIN px b ON a.img = b.img JOIN k ON b.row = a.row + dr AND b.col = a.col + dc, s GROUP BY 1, 2, 3""")
def gaussian_blur(t):
    return X.convolve(tiles(t), ["img"], "raw", X.gaussian_kernel(3, 1.0)).withColumn("conv", rnd(F.col("conv")))


@query(f"""WITH {_PX}, p AS (SELECT vec_id AS img, (vec_id % 61) / 10.0 AS x, (vec_id % 67) / 10.0 AS y FROM embeddings)
SELECT p.img, round(sum(val * (CASE WHEN row = floor(y) THEN 1-(y-floor(y)) ELSE y-floor(y) END) * (CASE WHEN col = floor(x) THEN 1-(x-floor(x)) ELSE x-floor(x) END)) /
 nullif(sum((CASE WHEN row = floor(y) THEN 1-(y-floor(y)) ELSE y-floor(y) END) * (CASE WHEN col = floor(x) THEN 1-(x-floor(x)) ELSE x-floor(x) END)), 0), 6)+0.0 AS interp
FROM p LEFT JOIN px ON px.img = p.img AND row IN (floor(y), floor(y)+1) AND col IN (floor(x), floor(x)+1) AND val IS NOT NULL GROUP BY p.img""")
def bilinear_lookup(t):
    p = t.embeddings.select(F.col("vec_id").alias("img"), (F.col("vec_id") % 61 / 10.0).alias("x"), (F.col("vec_id") % 67 / 10.0).alias("y"))
    return X.bilinear(p, tiles(t), ["img"], "x", "y", "val").select("img", rnd(F.col("interp")).alias("interp"))


@query(f"""WITH {_PX}, p AS (SELECT vec_id AS img, (vec_id % 61) / 10.0 AS x, (vec_id % 67) / 10.0 AS y FROM embeddings), f AS (SELECT * FROM px WHERE val > 0.2),
n AS (SELECT p.img, val, row_number() OVER (PARTITION BY p.img ORDER BY sqrt(pow(x-col,2)+pow(y-row,2)), row, col) AS r, sqrt(pow(x-col,2)+pow(y-row,2)) AS d FROM p JOIN f ON f.img = p.img),
b AS (SELECT p.img, sum(val * w) / nullif(sum(w), 0) AS v FROM (SELECT p.*, val, (CASE WHEN row = floor(y) THEN 1-(y-floor(y)) ELSE y-floor(y) END) * (CASE WHEN col = floor(x) THEN 1-(x-floor(x)) ELSE x-floor(x) END) AS w
 FROM p JOIN f ON f.img = p.img AND row IN (floor(y), floor(y)+1) AND col IN (floor(x), floor(x)+1)) p GROUP BY 1)
SELECT p.img, round(coalesce(b.v, n.val), 6)+0.0 AS interp FROM p LEFT JOIN b ON b.img = p.img LEFT JOIN n ON n.img = p.img AND n.r = 1 AND n.d <= 3""")
def bilinear_with_fallback(t):
    p = t.embeddings.select(F.col("vec_id").alias("img"), (F.col("vec_id") % 61 / 10.0).alias("x"), (F.col("vec_id") % 67 / 10.0).alias("y"), F.col("vec_id").alias("pid"))
    px = tiles(t).where("val > 0.2")
    return X.bilinear_or_nearest(p, px, ["img"], "x", "y", "val", "pid", 3.0).select("img", rnd(F.col("interp")).alias("interp"))


@query(f"WITH {_PX} SELECT img, row // 2 AS row, col // 2 AS col, round(avg(raw), 6)+0.0 AS raw FROM px GROUP BY 1, 2, 3")
def area_resample(t):
    return X.downsample(tiles(t), ["img"], "raw", 2).select("img", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), rnd(F.col("raw")).alias("raw"))


@query(f"""WITH {_PX}, c AS (SELECT a.img, a.row, a.col FROM px a JOIN px b ON a.img = b.img AND abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2, 3 HAVING min(CASE WHEN b.raw > -0.12 THEN 1 ELSE 0 END) = 1)
SELECT img, greatest(min(row)-1, 0) AS r0, least(max(row)+1, 7) AS r1, greatest(min(col)-1, 0) AS c0, least(max(col)+1, 7) AS c1 FROM c GROUP BY 1""")
def object_bounds(t):
    return X.object_bounds(tiles(t), ["img"], "raw", -0.12, 1, 8, 8)


@query("""WITH g AS (SELECT c_custkey // 50 AS row, c_custkey % 50 AS col, c_acctbal AS x, c_nationkey * 2.0 AS y FROM customer),
a AS (SELECT avg(abs(n.y - g.y)) AS ry FROM g JOIN g n ON n.row = g.row + 1 AND n.col = g.col), b AS (SELECT avg(abs(n.x - g.x)) AS rx FROM g JOIN g n ON n.row = g.row AND n.col = g.col + 1)
SELECT round(ry, 6) AS res_y, round(rx, 5) AS res_x FROM a, b""")
def ground_resolution(t):
    d = t.customer.select(F.floor(F.col("c_custkey") / 50).alias("row"), (F.col("c_custkey") % 50).alias("col"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 2.0).alias("y"))
    return X.ground_resolution(d, "x", "y").select(F.round("res_y", 6).alias("res_y"), F.round("res_x", 5).alias("res_x"))


@query(f"WITH {_PX} SELECT CAST(floor(raw * 50) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN raw > 0.05 THEN 1.0 ELSE 0 END), 6) AS bright FROM px GROUP BY 1")
def intensity_histogram(t):
    return tiles(t).groupBy(F.floor(F.col("raw") * 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("raw") > 0.05).cast("double")), 6).alias("bright"))


@query("""SELECT event_id, round(pow((event_id % 256)/255.0, 1/2.2)*255) AS gamma, round((event_id % 1024) * 255.0 / 1023, 5) AS depth, round(greatest(least(value - 10*0.5 + 2, 255), 0), 5) AS nobg,
 round(greatest(least((value-5)/95.0,1),0), 5) AS lin, round(least(value*0.5+10*0.3+20*0.1,255), 5) AS blue FROM events""")
def tone_curves(t):
    e = t.events
    v = F.col("value")
    return e.select("event_id", X.adjust_gamma((F.col("event_id") % 256).cast("double"), 2.2).alias("gamma"), F.round(X.change_depth((F.col("event_id") % 1024).cast("double"), 10, 8), 5).alias("depth"),
                    F.round(X.remove_background(v, F.lit(10.0), 0.5, 2.0), 5).alias("nobg"), F.round(X.stretch(v, F.lit(5.0), F.lit(100.0), 1.0, 1.0), 5).alias("lin"),
                    F.round(X.colour_correct(v, F.lit(10.0), F.lit(20.0), [[0.5, 0.3, 0.1]])[0], 5).alias("blue"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.998) AS q, quantile_cont(value, 0.02) AS b FROM events GROUP BY 1) SELECT event_id, round(least(greatest((value - b) / (q - b), 0), 1), 5) AS v FROM events JOIN q USING (event_type)""")
def brightness_normalise(t):
    """Background and highlight percentiles of each source stretch its values."""
    q = exact_quantiles(t.events, ["event_type"], "value", {"q": 0.998, "b": 0.02})
    d = t.events.join(q, "event_type")
    return d.select("event_id", F.round(X.stretch(F.col("value"), F.col("b"), F.col("q"), 1.0, 1.0), 5).alias("v"))


@query(f"WITH {_PX} SELECT row, col, round(avg(raw), 6)+0.0 AS mean, count(*) AS n FROM px GROUP BY 1, 2")
def image_stack_mean(t):
    return tiles(t).groupBy("row", "col").agg(rnd(F.avg("raw")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PX} SELECT img, row, col, CASE WHEN raw <> 0 THEN round(raw, 6)+0.0 END AS depth FROM px")
def depth_array_roundtrip(t):
    """Tiles written in the binary array format and read back as pixels."""
    e = t.embeddings.select(F.col("vec_id").alias("img"), D.encode_array(F.lit(8), F.lit(8), F.col("embedding")).alias("blob"))
    return D.pixels(e, ["img"], "blob").withColumn("depth", rnd(F.col("depth")))


@query("""SELECT s_suppkey AS img, 'main' AS section, CAST(1.5 AS DOUBLE) AS x_rot, s_acctbal AS z_off, CAST(s_nationkey AS DOUBLE) AS y_rot, 3 AS n_sun FROM supplier
UNION ALL SELECT s_suppkey, 'real', CAST(1.5 AS DOUBLE), -s_acctbal, CAST(s_nationkey AS DOUBLE), 3 FROM supplier""")
def label_scan(t):
    """State label text of every supplier, written and parsed; missing real values fall back."""
    c = lambda x: F.col(x).cast("double")
    text = L.label_text({"x_rot": F.lit(1.5), "y_rot": c("s_nationkey"), "z_off": c("s_acctbal"), "sun_asteroid_pos": F.lit("[ 0.0 0.0 1.0]")},
                        {"z_off": -c("s_acctbal")}, F.array(c("s_suppkey"), F.lit(-1.25), F.lit(2e8)))
    d = L.parse_labels(t.supplier.select(F.col("s_suppkey").alias("img"), text.alias("text")), "img", "text")
    return d.select("img", "section", "x_rot", "z_off", "y_rot", F.size("sun_asteroid_pos").alias("n_sun"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS ex, value * 0.5 AS ey, value - 30 AS ez, 100.0 + event_id % 50 AS dist FROM events)
SELECT event_id, round(1000*sqrt(ex*ex+ey*ey)/dist, 5) AS lat_err, round(1000*abs(ez)/dist, 5) AS dist_err, ex IS NULL AS failed, (100 + event_id % 50) < 140 AS valid, round((event_id % 50)/50.0, 6) AS nval FROM e""")
def result_log_errors(t):
    v = F.col("value")
    d = t.events.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(v).alias("ex"), (v * 0.5).alias("ey"), (v - 30).alias("ez"), (100.0 + F.col("event_id") % 50).alias("dist"))
    d = L.result_errors(d)
    return d.select("event_id", F.round("lat_err", 5).alias("lat_err"), F.round("dist_err", 5).alias("dist_err"), "failed",
                    L.valid(F.col("dist"), F.lit(0.0), F.lit(140.0)).alias("valid"), F.round(L.normalised(F.col("dist"), F.lit(100.0), F.lit(150.0)), 6).alias("nval"))


def obj_lines(t):
    """A mesh file of the part table: a vertex per part, a triangle per consecutive three parts."""
    k = F.col("p_partkey")
    n = t.part.count()
    s = lambda c: c.cast("string")
    v = t.part.select(F.lit("m").alias("mesh"), k.alias("line_no"), F.concat_ws(" ", F.lit("v"), s(F.col("p_size").cast("double")), s(F.col("p_retailprice")), s((k * k % 29).cast("double"))).alias("value"))
    f = t.part.where(k < n - 2).select(F.lit("m").alias("mesh"), (k + n).alias("line_no"), F.concat(F.lit("f "), s(k + 1), F.lit("/"), s(k % 100 + 1), F.lit(" "), s(k + 2), F.lit("/"), s(k % 50 + 1), F.lit(" "), s(k + 3), F.lit("/"), s(k % 10 + 1)).alias("value"))
    return v.unionByName(f)


_TRI = """v AS (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey * p_partkey % 29 AS DOUBLE) AS z FROM part), f AS (SELECT a.vid AS fid, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS wx, c.y-a.y AS wy, c.z-a.z AS wz
 FROM v a JOIN v b ON b.vid = a.vid + 1 JOIN v c ON c.vid = a.vid + 2)"""


@query(f"""WITH {_TRI}, n AS (SELECT fid, uy*wz-uz*wy AS nx, uz*wx-ux*wz AS ny, ux*wy-uy*wx AS nz FROM f)
SELECT fid, round(nx/nullif(sqrt(nx*nx+ny*ny+nz*nz),0), 5)+0.0 AS nx, round(nz/nullif(sqrt(nx*nx+ny*ny+nz*nz),0), 5)+0.0 AS nz FROM n WHERE nx*nx+ny*ny+nz*nz > 1e-9""")
def mesh_normals(t):
    lines = obj_lines(t)
    d = M.face_normals(M.faces(lines), M.vertices(lines), ["mesh"])
    return d.where("n.x <> 0 or n.y <> 0 or n.z <> 0").select("fid", rnd(F.col("n.x"), 5).alias("nx"), rnd(F.col("n.z"), 5).alias("nz"))


@query("""WITH n AS (SELECT count(*) AS n FROM part), c AS (SELECT p_partkey AS fid, unnest([0,1,2]) AS corner FROM part, n WHERE p_partkey < n - 2), e AS (SELECT fid, corner, fid + corner AS vid, fid % CASE corner WHEN 0 THEN 100 WHEN 1 THEN 50 ELSE 10 END AS tid FROM c)
SELECT tid, max_by(vid, fid * 3 + corner) AS vid FROM e GROUP BY 1""")
def texture_vertex_map(t):
    return M.texture_vertices(M.faces(obj_lines(t)), ["mesh"]).select("tid", "vid")


_LM = "lm AS (SELECT p_partkey AS kp_id, p_partkey % 7 = 0 AS bad, p_partkey % 11 AS inl, p_size AS tot FROM part), pts AS (SELECT kp_id, row_number() OVER (ORDER BY kp_id) - 1 AS pt3d_id FROM lm WHERE NOT bad AND inl > 3 AND inl / tot > 0.2)"


def _export(t):
    k = F.col("p_partkey")
    lm = t.part.select(k.alias("kp_id"), (k % 7 == 0).alias("bad_qlt"), (k % 11).alias("inlier_count"), F.col("p_size").alias("total_count"), *[F.col("p_retailprice").alias(c) for c in "xyz"])
    return D.export_points(lm)


@query(f"WITH {_LM} SELECT pt3d_id, kp_id, p_retailprice AS x, 128 AS r FROM pts JOIN part ON p_partkey = kp_id")
def dataset_points(t):
    return _export(t).select("pt3d_id", "kp_id", "x", "r")


@query(f"""WITH {_LM}, o AS (SELECT DISTINCT l_orderkey AS frame_id, l_partkey AS kp_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'F')
SELECT frame_id, pt3d_id, row_number() OVER (PARTITION BY frame_id ORDER BY kp_id) - 1 AS feat_id, kp_id / 0.5 * 2.0 AS u, printf('cam/frame%06d.png', frame_id) AS img_file FROM o JOIN pts USING (kp_id)""")
def dataset_observations(t):
    o = t.lineitem.select(F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("kp_id"), F.col("l_partkey").cast("double").alias("u"), F.col("l_partkey").cast("double").alias("v")).distinct()
    f = t.orders.select(F.col("o_orderkey").alias("frame_id"), (F.col("o_orderstatus") != "F").alias("has_pose"), F.lit(0.5).alias("img_sc"))
    return D.export_observations(o, _export(t), f, 2.0).select("frame_id", "pt3d_id", "feat_id", "u", "img_file")


@query("""SELECT s_suppkey AS sensor_id, s_acctbal * 0.5 AS fx, 320 AS width, 8 AS n, CAST(s_nationkey AS DOUBLE) AS d0, CAST(0 AS DOUBLE) AS d7 FROM supplier""")
def camera_rows(t):
    s = t.supplier.select(F.col("s_suppkey").alias("sensor_id"), F.lit(640).alias("width"), F.lit(480).alias("height"), *[F.col("s_acctbal").alias(c) for c in ("fx", "fy", "cx", "cy")],
                          F.array(F.col("s_nationkey").cast("double"), F.lit(0.1)).alias("dist"))
    d = D.camera_row(s, 0.5)
    return d.select("sensor_id", "fx", "width", F.size("dist").alias("n"), F.col("dist")[0].alias("d0"), F.col("dist")[7].alias("d7"))


@query(f"""WITH {_PX}, p AS (SELECT vec_id AS img, CAST(vec_id % 8 AS INTEGER) AS row, CAST(vec_id // 8 % 8 AS INTEGER) AS col FROM embeddings)
SELECT p.img FROM p JOIN px ON px.img = p.img AND abs(px.row-p.row) <= 1 AND abs(px.col-p.col) <= 1 GROUP BY 1 HAVING min(raw) >= -0.2 AND max(raw) >= 0.1""")
def brightness_window(t):
    p = t.embeddings.select(F.col("vec_id").alias("img"), (F.col("vec_id") % 8).cast("int").alias("row"), (F.floor(F.col("vec_id") / 8) % 8).cast("int").alias("col"))
    return X.bright_enough(p, tiles(t), ["img"], "raw", 3, 8, 8, -0.2, 0.1).select("img")
