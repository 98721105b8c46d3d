"""A Merkle manifest of a dataset: one tree per group, a tree over the groups' roots, and a proof for every row.

Trees are built level by level, each written before the next one is built: a row per inner node holds the digests of its children and a
link to the place in its own parent. A recursive query then climbs from every leaf to the root: each step joins the node above, appends the
siblings and folds the leaf's digest with them. Two things keep that climb even and small:

* Above the first level the siblings of all leaves below one node are the same, so only the first leaf of a run carries the list.
* A node above more than one leaf in ``SHARE`` is heavy. There are fewer than ``SHARE`` heavy nodes per level, so these are broadcast; what lies above a
  heavy node is heavy, so leaves first climb the light nodes by a plain join, where no key is hot, and then the heavy ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from navlytics.llm.shared import keep

#: Children of a node, and the share of all leaves (one in so many) above which a node is heavy.
FAN, SHARE = 8, 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
#: The number of the tree over the groups' roots; groups count from 0.
_TOP = -1


def hashed(hex_text: Column) -> Column:
    return F.unhex(F.sha2(hex_text.cast("binary"), 256))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value in decimal or as text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda d: F.lower(F.hex(d))), "")


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place from 0 within ``by`` in the given order, and ``count``, the rows of ``by``.

    Rows are dealt by ranges of the order, whatever ``by`` they have, and counted per range; so no task holds a whole key. Ranges are found by
    sampling, so ties of the whole order stay together.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(by, *order).withColumn("__m", F.monotonically_increasing_id())
    dealt = keep(dealt.withColumn("__p", F.shiftright("__m", 33)), "numbered")
    part = dealt.groupBy(by, "__p").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    part = part.select(by, "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
                       F.sum("__n").over(W.partitionBy(by)).alias("count"))
    return dealt.join(part, [by, "__p"]).withColumn("idx", F.col("__m") + F.col("__shift")).drop("__m", "__p", "__shift")


def _build(nodes: DataFrame, level: int = 0) -> tuple[list[DataFrame], list[DataFrame]]:
    """(inner nodes per level, roots): from (tree, idx, digest, count, weight), until every tree has a single node left."""
    inner, roots = [], []
    while True:
        roots.append(nodes.where("count = 1").select("tree", "digest", "weight"))
        most = nodes.agg(F.max("count")).first()[0]
        if not most or most == 1:
            return inner, roots
        g = nodes.where("count > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("idx")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("c"), F.max("count").alias("count"), F.sum("weight").alias("weight"))
        g = g.select("tree", F.lit(level).alias("level"), "idx", F.col("c.digest").alias("children"), "weight",
                     F.expr(f"(count + {FAN - 1}) div {FAN}").alias("count"))
        g = keep(g.withColumn("digest", hashed(_joined(F.col("children")))), "merkle-level")
        inner.append(g)
        nodes, level = g.select("tree", "idx", "digest", "count", "weight"), level + 1


def _links(nodes: DataFrame, level: Column, groups: DataFrame | None) -> DataFrame:
    """Adds where a node's parent is: up_tree, up_level, up_idx, up_place. Null above the root."""
    single = F.col("count") == 1
    d = nodes if groups is None else nodes.join(groups.select(F.col("tree"), F.col("idx").alias("__rank"), F.col("count").alias("__groups")), "tree", "left")
    own = F.struct(F.col("tree").alias("t"), level.alias("l"), F.expr(f"idx div {FAN}").alias("i"), F.expr(f"cast(idx % {FAN} AS int)").alias("p"))
    top = F.struct(F.lit(_TOP).cast("long").alias("t"), F.lit(0).alias("l"), F.expr(f"__rank div {FAN}").alias("i"), F.expr(f"cast(__rank % {FAN} AS int)").alias("p"))
    up = F.when(~single, own) if groups is None else F.when(~single, own).when(F.col("__groups") > 1, top)
    d = d.withColumn("__up", up)
    return d.withColumns({"up_tree": F.col("__up.t"), "up_level": F.col("__up.l"), "up_idx": F.col("__up.i"), "up_place": F.col("__up.p")}).drop(
        "__up", "__rank", "__groups")


_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT * FROM {start}
  UNION ALL
  SELECT c.leaf_tree, c.leaf_idx, c.id, g.up_tree, g.up_level, g.up_idx, g.up_place, g.up_heavy,
    unhex(sha2(cast(array_join(transform(concat(slice(g.children, 1, c.place), array(c.fold), slice(g.children, c.place + 2, {fan})),
      d -> lower(hex(d))), '') AS binary), 256)) AS fold,
    CASE WHEN c.siblings IS NOT NULL THEN concat(c.siblings, slice(g.children, 1, c.place), slice(g.children, c.place + 2, {fan})) END AS siblings,
    CASE WHEN c.siblings IS NOT NULL AND c.tree >= 0 AND g.up_tree = {top} THEN g.digest ELSE c.subroot END AS subroot
  FROM climb c JOIN {nodes} g ON c.tree = g.tree AND c.level = g.level AND c.idx = g.idx
)
SELECT * FROM climb WHERE {stop}
"""


def _climb(spark: SparkSession, start: DataFrame, nodes: DataFrame, stop: str) -> DataFrame:
    """Rows of ``start`` after climbing ``nodes`` as far as they go, written; ``stop`` says which rows of the recursion are ends.

    The recursion may yield a row per leaf and level, so Spark's limit of rows is lifted for this query.
    """
    name = uuid.uuid4().hex
    start.createOrReplaceTempView(f"start_{name}")
    nodes.createOrReplaceTempView(f"nodes_{name}")
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return keep(spark.sql(_CLIMB.format(start=f"start_{name}", nodes=f"nodes_{name}", fan=FAN, top=_TOP, stop=stop)), "merkle-climb")
    finally:
        spark.conf.set(_ROW_LIMIT, before)
        spark.catalog.dropTempView(f"start_{name}")
        spark.catalog.dropTempView(f"nodes_{name}")


def manifest(docs: DataFrame, fields: list[str], group: str, id_col: str, tampered: dict[str, Column]) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the digest of ``fields``; ``tampered`` gives the expressions that stand for some of them in the recomputed leaf. Leaves of one value of ``group`` (null is a
    value) ascend by id, null first, then by digest, so repeated ids have a defined order and repeated rows a proof each. Values of
    ``group`` ascend bytewise, null first. An empty table gives an empty result; columns not named are not read.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first
    leaves = docs.select(
        key.alias("key"), F.col(id_col).alias("id"), hashed(F.concat(*[field(F.col(c)) for c in fields])).alias("leaf"),
        hashed(F.concat(*[field(tampered.get(c, F.col(c))) for c in fields])).alias("seen"))
    leaves = keep(leaves, "merkle-digests")  # finding ranges reads the rows twice, the texts once
    leaves = keep(numbered(leaves, "key", ["id", "leaf"]), "merkle-leaves")
    total = leaves.count()
    if not total:
        text = [F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        return leaves.select(F.col("id").alias(id_col), *text, F.lit(True).alias("verified"))
    keys = leaves.where("idx = 0").select("key", F.col("count").alias("size"), F.lit(0).alias("one"))
    trees = keep(numbered(keys, "one", ["key"]).select("key", "idx", "count"), "merkle-groups")
    # (key, its tree) joins the leaves on the key and a slice of their places, so that no slice is more than one in SHARE of all leaves
    cut = max(1, total // SHARE)
    slices = leaves.where(F.col("idx") % cut == 0).select("key", F.expr(f"idx div {cut}").alias("slice"))
    slices = slices.join(trees.select("key", F.col("idx").alias("tree")), "key")
    leaves = leaves.withColumn("slice", F.expr(f"idx div {cut}")).join(slices, ["key", "slice"])
    leaves = keep(leaves.select("tree", "idx", "id", F.col("leaf").alias("digest"), "seen", "count", F.lit(1).cast("long").alias("weight")), "merkle-leaves")

    inner, roots = _build(leaves.drop("id", "seen"))
    groups = trees.select(F.col("idx").alias("tree"), F.col("idx"), "count")
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    tops = subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(trees.count()).cast("long").alias("count"), "weight")
    top_inner, top_roots = _build(tops)
    ends = top_roots[0]
    for r in top_roots[1:]:
        ends = ends.unionByName(r)
    root = F.lit(bytes(ends.first().digest))

    nodes = None
    for level, g in enumerate(inner):
        d = _links(g, F.lit(level + 1), groups)
        nodes = d if nodes is None else nodes.unionByName(d)
    for level, g in enumerate(top_inner):
        d = _links(g, F.lit(level + 1), None)
        nodes = d if nodes is None else nodes.unionByName(d)
    start = _links(leaves, F.lit(0), groups)
    start = start.select(F.col("tree").alias("leaf_tree"), F.col("idx").alias("leaf_idx"), "id", "up_tree", "up_level", "up_idx", "up_place", "seen",
                         F.when(F.col("count") == 1, F.col("digest")).alias("subroot"))
    if nodes is None:  # a single leaf
        ready = start.select("leaf_tree", "leaf_idx", "id", F.col("seen").alias("fold"), F.array().cast("array<binary>").alias("siblings"), "subroot")
        runs = leaves.limit(0).select(F.col("tree").alias("leaf_tree"), F.col("idx").alias("run"), F.array("digest").alias("children"))
    else:
        nodes = nodes.select("tree", "level", "idx", "children", "digest", "weight", "up_tree", "up_level", "up_idx", "up_place")
        weights = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"),
                               (F.col("weight") * SHARE > total).alias("up_heavy"))
        link = ["up_tree", "up_level", "up_idx"]
        nodes = keep(nodes.join(weights, link, "left").withColumn("heavy", F.col("weight") * SHARE > total), "merkle-nodes")
        start = start.join(weights, link, "left").select(
            "leaf_tree", "leaf_idx", "id", F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_idx").alias("idx"),
            F.col("up_place").alias("place"), F.col("up_heavy").alias("heavy"), F.col("seen").alias("fold"),
            F.when(F.col("leaf_idx") % FAN == 0, F.array().cast("array<binary>")).alias("siblings"), "subroot")
        upper = _climb(spark, start, nodes.where("NOT heavy"), "heavy OR tree IS NULL")
        ready = _climb(spark, upper, F.broadcast(nodes.where("heavy")), "tree IS NULL")
        runs = nodes.where(f"level = 0 AND tree <> {_TOP}").select(F.col("tree").alias("leaf_tree"), F.col("idx").alias("run"), "children")
    run = F.expr(f"leaf_idx div {FAN}").alias("run")
    lists = ready.where("siblings IS NOT NULL").select("leaf_tree", run, "siblings", F.coalesce("subroot", root).alias("subroot"))
    lists = lists.join(runs, ["leaf_tree", "run"], "left")
    d = ready.select("leaf_tree", run, F.expr(f"cast(leaf_idx % {FAN} AS int)").alias("place"), "id", "fold").join(lists, ["leaf_tree", "run"])
    c, p = F.col("children"), F.col("place")
    whole = F.when(c.isNull(), F.col("siblings")).otherwise(F.concat(
        F.slice(c, F.lit(1), p), F.slice(c, p + 2, F.lit(FAN)), F.slice(F.col("siblings"), F.size(c), F.size("siblings"))))
    text = lambda x: F.lower(F.hex(x))
    return d.select(
        F.col("id").alias(id_col), text(F.coalesce(F.get(c, p), F.col("subroot"))).alias("leaf"), text("subroot").alias("subroot"), text(root).alias("root"),
        F.sha2(_joined(whole).cast("binary"), 256).alias("proof_sha256"), text("fold").alias("folded_root"), (F.col("fold") == root).alias("verified"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
