"""Exact top-k inner products by norm buckets with coordinate or length pruning.

Vectors are sorted by length into buckets. For a query q and a bucket whose longest vector has length L, a product above the
query's k-th best so far, t, needs a cosine of at least c = t / (|q| L), the bucket's local threshold. A bucket with c > 1 is
skipped. With c high, each of q's largest coordinates x (of the unit vector) bounds a candidate's own unit coordinate y by
x y + sqrt(1 - x^2) sqrt(1 - y^2) >= c, and only candidates within all bounds are verified (coordinate pruning). With c low, candidates
that are too short are cut off (length pruning). What is left gets its integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType

from navlytics.llm.shared import keep

#: Rows of a bucket, queries of a block, coordinates that prune, and the local threshold from which they do.
BUCKET_ROWS, QUERY_ROWS, FOCUS, COSINE = 4096, 512, 4, 0.5
#: Relative slack of all bounds, far above the rounding of doubles: nothing is pruned by rounding.
SLACK = 1e-9
_BLOCK = "block long, ids binary, vectors binary, dims int, longest double"


def integers(v: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component x as double; null if the vector or a component is null or not finite."""
    x = v.cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(~bad, F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")))


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Dense matrices of at most ``most`` rows of equal dimension, longest vectors first: a row per block of a range of lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for i, v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids, vs = held.setdefault(n, ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) >= most:
                    yield block(n, *held.pop(n))
        for n, (ids, vs) in held.items():
            yield block(n, ids, vs)

    def block(n: int, ids: list, vs: list) -> pa.RecordBatch:
        m = np.array(vs, dtype="<i8").reshape(len(ids), n)
        longest = float(np.sqrt((m.astype(float) ** 2).sum(axis=1).max())) if n else 0.0
        cols = [pa.array([0], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()),
                pa.array([n], pa.int32()), pa.array([longest])]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "vectors", "dims", "longest"])

    made = rows.select("id", "v", F.size("v").alias("n")).mapInArrow(run, _BLOCK)
    return keep(made.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    NONE = -(1 << 62)

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), self.NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def threshold(self, q: int) -> float:
        t = self.score[q, self.k - 1]
        return float(t) if t != self.NONE else -np.inf

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > 4 * self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        s, i = np.concatenate([self.score[q], scores]), np.concatenate([self.id[q], ids])
        top = np.lexsort((i, -s))[:self.k]
        self.score[q], self.id[q] = s[top], i[top]


class Bucket:
    def __init__(self, ids: np.ndarray, m: np.ndarray):
        length = np.sqrt((m.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.m, self.length = ids[order], m[order], length[order]
        self.unit = self.m / np.maximum(self.length, 1e-300)[:, None]
        self.longest = self.length[0] if len(ids) else 0.0

    def search(self, best: Best, q: int, qid: int, v: np.ndarray, focus: int = FOCUS) -> None:
        t, norm = best.threshold(q), float(np.sqrt((v.astype(float) ** 2).sum()))
        if t > 0:
            local = t / max(norm * self.longest, 1e-300) * (1 - SLACK) - SLACK
            if local > 1:
                return
            # length pruning: the bucket is sorted, so a prefix is left
            n = int(np.searchsorted(-self.length, -(t / norm) * (1 - SLACK), side="right"))
            pick = np.arange(n)
            if local >= COSINE:
                x = v / norm
                for f in np.argsort(-np.abs(x))[:focus]:
                    half = np.sqrt(max(0.0, (1 - local * local) * (1 - x[f] * x[f]))) + SLACK
                    y = self.unit[pick, f]
                    low = x[f] * local - half if x[f] > -local else -1.0
                    high = x[f] * local + half if x[f] < local else 1.0
                    pick = pick[(y >= low - SLACK) & (y <= high + SLACK)]
        else:
            pick = np.arange(len(self.ids))
        pick = pick[self.ids[pick] != qid]
        if len(pick):
            best.offer(q, self.ids[pick], self.m[pick] @ v)


def _open(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<i8").reshape(len(i), dims)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0,
           bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of every row that is a query with all rows but its own id.

    Ties go to the smaller id. Rows with a null id, or whose vector is null or has null or non-finite components, take no part; rows
    of different dimensions never meet. Repeated ids are candidates of their own (never of a query with the same id), and as queries answered once.
    Fewer than k candidates give fewer ranks; no queries give an empty table. Other columns are not read.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), integers(F.col(vec_col), scale).alias("v"), is_query.alias("q")).where("v is not null")
    rows = keep(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))), "vectors")
    n = rows.count()
    candidates = blocks(rows.repartitionByRange(max(1, -(-n // (4 * bucket_rows))), F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id"), bucket_rows)
    asked = rows.where("q").dropDuplicates(["id"])
    queries = blocks(asked.repartition(max(1, -(-asked.count() // query_rows)), "id"), query_rows)
    # Start: each query block searches the bucket of the longest vectors of its dimension, which gives a lower bound of its k-th best.
    top = candidates.groupBy("dims").agg(F.max_by("block", "longest").alias("block"))
    first = keep(_against(queries.withColumn("bounds", F.lit(None).cast("binary")), candidates.join(top, ["dims", "block"], "left_semi"), k, True), "first-bounds")
    # A bucket is sent to a query block only if one of the block's queries could still gain from it.
    need = queries.join(first.select(F.col("query_block").alias("block"), "bounds", "need"), "block")
    found = _against(need, candidates, k, False)
    each = found.select("query_block", F.posexplode(F.arrays_zip("query_ids", "hits")).alias("at", "x")).select(
        F.col("x.query_ids").alias("query_id"), F.explode("x.hits").alias("h")).select("query_id", F.col("h.id").alias("id"), F.col("h.score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _against(queries: DataFrame, candidates: DataFrame, k: int, first: bool) -> DataFrame:
    """Search buckets for query blocks; a row per pair of them.

    ``first``: returns each query's k-th best as bounds, and the least length that a bucket needs to be of use to the block.
    """
    q = queries.select(F.col("block").alias("query_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "dims", "bounds",
                       *([] if first else ["need"]))
    pairs = q.join(candidates, "dims")
    if not first:
        pairs = pairs.where(F.col("longest") >= F.col("need"))
    pairs = pairs.select("query_block", "q_ids", "q_vectors", "dims", "bounds", "ids", "vectors")
    out = "query_block long, bounds binary, need double" if first else "query_block long, query_ids array<long>, hits array<array<struct<id:long,score:long>>>"
    hit = pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[bytes, Bucket] | None = None
        for b in batches:
            for r in b.to_pylist():
                if seen is None or seen[0] != r["ids"]:
                    seen = r["ids"], Bucket(*_open(r["ids"], r["vectors"], r["dims"]))
                ids, m = _open(r["q_ids"], r["q_vectors"], r["dims"])
                best = Best(len(ids), k)
                bounds = np.frombuffer(r["bounds"], "<f8") if r["bounds"] is not None else np.full(len(ids), -np.inf)
                floor = bounds.copy()
                best.threshold = lambda i, own=Best.threshold, best=best: max(own(best, i), floor[i])
                for i in range(len(ids)):
                    seen[1].search(best, i, int(ids[i]), m[i])
                if first:
                    kth = np.array([Best.threshold(best, i) for i in range(len(ids))])
                    norm = np.sqrt((m.astype(float) ** 2).sum(axis=1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        needs = np.where(kth > 0, kth / np.maximum(norm, 1e-300) * (1 - SLACK), 0.0)
                    yield pa.RecordBatch.from_arrays([pa.array([r["query_block"]]), pa.array([kth.astype("<f8").tobytes()], pa.binary()), pa.array([float(needs.min())])],
                                                     ["query_block", "bounds", "need"])
                else:
                    none = np.iinfo(np.int64).max
                    hits = [[{"id": int(i), "score": int(s)} for i, s in zip(best.id[x], best.score[x]) if i != none] for x in range(len(ids))]
                    yield pa.RecordBatch.from_arrays([pa.array([r["query_block"]]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([hits], hit)],
                                                     ["query_block", "query_ids", "hits"])

    return pairs.mapInArrow(run, out)
