"""Connected components of links: union-find inside tasks, then contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navlytics.llm.shared import keep

#: Links that a task holds at once for its union-find.
BATCH_LINKS = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes in links a-b, the root being the least node of the component; roots are left out."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes)).tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(a)
    for x, y in zip(index[:n].tolist(), index[n:].tolist()):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest(links: DataFrame, batch: int) -> DataFrame:
    """Replace each task's links by the star of each of its components: (node, root), root < node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def shrink() -> tuple[np.ndarray, np.ndarray]:
            return union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > batch:
                small = shrink()
                if len(small[0]) > batch // 2:  # it doesn't shrink further: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(small[0]), pa.array(small[1])], ["node", "root"])
                    small = small[0][:0], small[1][:0]
                held, n = [small], len(small[0])
        if held:
            x, y = shrink()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["node", "root"])

    return links.mapInArrow(run, "node long, root long")


def components(links: DataFrame, a: str, b: str, batch: int = BATCH_LINKS) -> DataFrame:
    """(node, component) for every node that has a link; the component is its least node.

    Each round spreads the links over tasks of about ``batch`` each and turns every task's links into stars. A node that got several roots links
    them with its least one and itself too; so components contract until every node has one root that is a root itself, or until one task's
    batch takes all links that are left. Nulls and loops are left out.
    """
    cur = links.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root"))
    while True:
        tasks = max(1, -(-cur.count() // batch))
        cur = keep(_forest(cur.coalesce(tasks), batch), "forest")
        if tasks == 1:
            return cur.withColumnRenamed("root", "component")
        low = keep(cur.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("high")), "low")
        # hook: the roots of a node are linked with the least of them
        hooks = cur.join(low.where("root < high").select("node", F.col("root").alias("low")), "node").where("root <> low").select(
            F.col("root").alias("x"), F.col("low").alias("y")).distinct()
        # jump: a root that has a root itself passes it on
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jump = low.select("node", "root").join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        jump = keep(jump, "jump")
        hooks = keep(hooks, "hooks")
        if hooks.isEmpty() and jump.where("moved").isEmpty():
            return jump.select("node", F.col("root").alias("component"))
        cur = jump.select("node", "root").unionByName(hooks.select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("root")))
