"""Connected components of a match graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navlytics.operators.skew import heavy_keys, salted_lookup
from navlytics.session import cut_lineage


def _hook(edges: DataFrame, up: bool) -> DataFrame:
    """One star step on (u, v): link the chosen neighbours of each node to its smallest one."""
    if up:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a hub's edges are spread over salts; the lookup has one row per node
    joined = salted_lookup(both, low, "u", heavy=heavy_keys(both, "u"))
    if up:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the edge list; a component is named by its least node."""
    e = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"))
    nodes = e.select("u").union(e.select("v")).distinct()
    cur = e.where("u <> v").distinct()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = None
    while True:
        cur = cut_lineage(_hook(_hook(cur, True), False))
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return nodes.join(cur, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
