"""Wavefront meshes as vertex, texture-coordinate and face tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navlytics.functions import vectors as V
from navlytics.operators.ordered import Ordered


def read_obj_lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, line_no, value); a file is one row here, so the line order is known."""
    d = spark.read.text(path, wholetext=True).withColumn("mesh", F.input_file_name())
    return d.select("mesh", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def _numbered(lines: DataFrame, tag: str, fields: list[str], ident: str) -> DataFrame:
    d = lines.where(F.col("value").startswith(f"{tag} ")).withColumn("__f", F.split(F.trim("value"), r"\s+"))
    d = Ordered(d, ["mesh"], "line_no", "line_no").prefix(rank="__r")
    return d.select("mesh", (F.col("__r") - 1).cast("bigint").alias(ident), *[F.element_at("__f", i + 2).cast("double").alias(c) for i, c in enumerate(fields)])


def vertices(lines: DataFrame) -> DataFrame:
    return _numbered(lines, "v", ["x", "y", "z"], "vid")


def texcoords(lines: DataFrame) -> DataFrame:
    return _numbered(lines, "vt", ["u", "v"], "tid")


def faces(lines: DataFrame) -> DataFrame:
    """(mesh, fid, corner, vid, tid, nid) with 0-based ids; only triangles are allowed."""
    d = lines.where(F.col("value").startswith("f ")).withColumn("__c", F.slice(F.split(F.trim("value"), r"\s+"), 2, 1000))
    d = d.withColumn("__c", F.when(F.size("__c") == 3, F.col("__c")).otherwise(F.raise_error(F.lit("only triangle faces are supported")).cast("array<string>")))
    d = Ordered(d, ["mesh"], "line_no", "line_no").prefix(rank="__r")
    e = d.select("mesh", (F.col("__r") - 1).cast("bigint").alias("fid"), F.posexplode("__c").alias("corner", "__p")).withColumn("__p", F.split("__p", "/"))
    part = lambda i: (F.nullif(F.try_element_at("__p", F.lit(i)), F.lit("")).cast("bigint") - 1)
    return e.select("mesh", "fid", "corner", part(1).alias("vid"), part(2).alias("tid"), part(3).alias("nid"))


def gather_corners(f: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
    """Faces with the coordinates of every corner."""
    return f.join(v, [*keys, "vid"])


def face_normals(f: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fid, n): unit normal of each triangle."""
    c = gather_corners(f, v, keys)
    at = lambda i: F.max(F.when(F.col("corner") == i, F.struct("x", "y", "z"))).alias(f"p{i}")
    return c.groupBy(*keys, "fid").agg(at(0), at(1), at(2)).select(*keys, "fid", V.triangle_normal(F.col("p0"), F.col("p1"), F.col("p2")).alias("n"))


def texture_vertices(f: DataFrame, keys: list[str]) -> DataFrame:
    """Vertex last used with each texture coordinate."""
    return f.where("tid is not null").groupBy(*keys, "tid").agg(F.max_by("vid", F.struct("fid", "corner")).alias("vid"))
