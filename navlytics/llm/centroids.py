"""Centroid clustering in exact integers with a distance matrix that is kept and updated by increments.

Every vector keeps its inner product with every centroid. When centroids move, only their changed components are
looked at: the product grows by (vector component) * (change). Squared distances follow from the products and the two squared
lengths, and the nearest centroid is chosen anew. The sums behind the centroids are updated the same way, by the vectors that
changed their cluster. All numbers are integers, so no order of summation matters. The state of a round is written to the
shared folder before the next one reads it; the driver holds the centroids only (``k`` times ``dims`` integers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from navlytics.llm.shared import discard, new_folder

#: What is left of a vector between rounds.
_STATE = "v array<int>, norm long, dots array<long>, cluster int, before int, distance long"


def largest_component(dims: int) -> int:
    """Components below this keep every distance of ``dims`` components, and all that leads to it, within 64 bits."""
    return int((2**62 / dims) ** 0.5) // 2


def integers(v: Column, dims: int, scale: float = 256.0) -> Column:
    """floor(scale * x) per component; null unless there are exactly ``dims`` components, none null or not finite.

    A component whose distances would not fit 64 bits raises an error that names the bound.
    """
    x = v.cast("array<double>")
    most = largest_component(dims)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    one = lambda e: F.when(F.abs(e) * scale < most, F.floor(e * F.lit(scale)).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"component at or beyond {most}/{scale} would overflow a distance: "), e.cast("string"))).cast("int"))
    return F.when((F.size(x) == dims) & ~bad, F.transform(x, one))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel(), kind))


def _assign(rows: DataFrame, changes: list[tuple[list[int], list[int]]], lengths: list[int], dims: int) -> DataFrame:
    """Products after ``changes`` (per centroid: components and what they grow by), then the nearest centroid of each row."""
    k = len(changes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _rows(b.column("v"), dims)
            if "dots" in b.schema.names:
                dots, norm, before = _rows(b.column("dots"), k), b.column("norm").to_numpy(), b.column("cluster")
            else:
                dots, norm, before = np.zeros((len(v), k), np.int64), (v * v).sum(1), pa.nulls(len(v), pa.int32())
            for j, (at, by) in enumerate(changes):
                if at:
                    dots[:, j] += v[:, at] @ np.array(by, np.int64)
            d = norm[:, None] - 2 * dots + np.array(lengths, np.int64)
            near = d.argmin(1)  # the first of equal distances is the smaller number
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(norm), _lists(dots, pa.int64()), pa.array(near.astype(np.int32)), before,
                 pa.array(d[np.arange(len(d)), near])], names=["id", "v", "norm", "dots", "cluster", "before", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_STATE}")


def _moved(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster: by how much its count and component sums grew. Only rows that changed their cluster are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = np.hstack([np.ones((b.num_rows, 1), np.int64), _rows(b.column("v"), dims)])
            for name, sign in (("cluster", 1), ("before", -1)):
                c = b.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for j in np.unique(c[c >= 0]).tolist():
                    held[j] = held.get(j, 0) + sign * v[c == j].sum(0)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), _lists(np.vstack(list(held.values())), pa.int64())], names=["cluster", "s"])

    parts = state.where(~F.col("cluster").eqNullSafe(F.col("before"))).select("cluster", "before", "v").mapInArrow(run, "cluster int, s array<long>")
    total: dict[int, list[int]] = {}
    for r in parts.select("cluster", F.posexplode("s")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect():  # at most k * (dims + 1) rows
        total.setdefault(r.cluster, [0] * (dims + 1))[r.pos] = r.s
    return {j: (s[0], s[1:]) for j, s in total.items()}


def starts(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``salt`` and their id; a null id comes last, ties go by components."""
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    best = rows.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [list(r.v) for r in best.collect()]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
            scale: float = 256.0, salt: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. With fewer than k vectors there
    are as many centroids as vectors. Repeated rows count as often as they occur, each with a row of its own. A null id never starts a centroid
    while other vectors are left. Of equal distances the smaller number wins; a cluster without vectors keeps its
    centroid. An empty table gives an empty result. Columns other than the two named are not read. A component too large for 64-bit distances raises.
    """
    spark = vectors.sparkSession
    path = new_folder(spark, "clusters-0")
    rows = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col), dims, scale).alias("v")).where("v IS NOT NULL")
    rows.write.parquet(path)
    state = spark.read.parquet(path)
    centroids = starts(state, k, salt)
    if not centroids:
        return state.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    changes = [([i for i, x in enumerate(c) if x], [x for x in c if x]) for c in centroids]
    sums = [[0] * (dims + 1) for _ in centroids]
    for r in range(rounds + 1):
        after = new_folder(spark, f"clusters-{r + 1}")
        _assign(state, changes, [sum(x * x for x in c) for c in centroids], dims).write.parquet(after)
        discard(path)
        path, state = after, spark.read.parquet(after)
        if r == rounds:
            break
        moved = _moved(state, dims)
        if not moved:  # the same vectors make the same centroids: nothing can change any more
            break
        for j, (n, s) in moved.items():
            sums[j] = [a + b for a, b in zip(sums[j], [n, *s])]
        new = [[x // s[0] for x in s[1:]] if s[0] else c for s, c in zip(sums, centroids)]
        changes = [([i for i in range(dims) if a[i] != b[i]], [b[i] - a[i] for i in range(dims) if a[i] != b[i]]) for a, b in zip(centroids, new)]
        centroids = new
    spread = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = F.create_map(*[x for j, s in spread.items() for x in (F.lit(j), F.struct(
        F.lit(s).cast("long").alias("inertia"), F.lit(hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()).alias("sha")))])
    own = facts[F.col("cluster")]
    return state.select(
        F.col("id").alias(id_col), "cluster", "distance", own["inertia"].alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"), own["sha"].alias("centroid_sha256"))
