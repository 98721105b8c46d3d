"""Exact nearest-neighbour joins that never form all pairs as rows and never hold a whole group.

``block_best`` compares bounded blocks of needles and candidates inside Arrow tasks and emits only
the best k per needle and block.  ``knn_join`` adds exact metric pruning.  Vectors of few components
meet the leaves of a k-d tree (``Cells``) whose boxes come near enough, so that work grows with the
rows.  Longer ones are assigned to the cell of their nearest pivot, and the triangle inequality tells
each needle which cells can hold one of its k nearest; blocks of the rest are compared by matrix
products, and candidates within rounding of the best are measured again.  Tree, pivots and per-cell
facts are bounded, so they are the only data that passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from navlytics.operators.skew import HEAVY_SHARE, heavy_keys, salted_lookup
from navlytics.session import written

BLOCK_ROWS = 2048
MAX_PIVOTS = 1024
STRIP = 512
#: Up to this many components the leaves of a tree prune well.
TREE_DIMS = 6
#: Rows a leaf should hold, leaves at most, and sampled rows a leaf.
LEAF_ROWS, MAX_LEAVES, LEAF_SAMPLE = 1024, 32768, 16
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.float64)


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """len(a) x len(b) distances, in strips that keep the temporary small."""
    out = np.empty((len(a), len(b)))
    if metric == "hamming" or (metric == "l2" and a.shape[1] > TREE_DIMS):
        strip = max(1, 4_000_000 // max(1, b.size))
        for s in range(0, len(a), strip):
            x = a[s : s + strip, None, :]
            if metric == "hamming":
                out[s : s + strip] = _POPCOUNT[np.bitwise_xor(x, b[None])].sum(-1)
            else:
                d = x - b[None]
                out[s : s + strip] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        return out
    if metric not in ("l1", "l2", "linf"):
        raise ValueError(f"unknown metric {metric}")
    bt = np.ascontiguousarray(b.T)
    strip = max(1, 32_768 // max(1, len(b)))  # both temporaries stay in the cache
    for s in range(0, len(a), strip):
        x, acc = a[s : s + strip], out[s : s + strip]
        acc[:] = 0.0
        t = np.empty_like(acc)
        for i in range(a.shape[1]):
            np.subtract(x[:, i, None], bt[i], out=t)
            if metric == "l2":
                np.multiply(t, t, out=t)
            else:
                np.abs(t, out=t)
            (np.maximum if metric == "linf" else np.add)(acc, t, out=acc)
    return np.sqrt(out, out=out) if metric == "l2" else out


def stack(vectors: pd.Series, metric: str) -> np.ndarray:
    if metric == "hamming":
        return np.vstack([np.frombuffer(bytes(v), dtype=np.uint8) for v in vectors])
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """k-th smallest of every row, infinity where a row is shorter."""
    if k > s.shape[1]:
        return np.full(len(s), np.inf)
    if k > 4:
        return np.partition(s, k - 1, axis=1)[:, k - 1]
    rows, held = np.arange(len(s)), []
    for _ in range(k - 1):
        at = s.argmin(1)
        held.append((at, s[rows, at]))
        s[rows, at] = np.inf
    low = s.min(1)
    for at, v in reversed(held):
        s[rows, at] = v
    return low


def _first_k(rows: np.ndarray, cols: np.ndarray, val: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((cols, val, rows))
    rows, cols, val = rows[order], cols[order], val[order]
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    keep = rank < k
    return rows[keep], cols[keep], val[keep]


def smallest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k smallest finite values of every row, ties to the earlier column."""
    if k == 1 and s.shape[1]:
        cols = s.argmin(1)
        val = s[np.arange(len(s)), cols]
        rows = np.flatnonzero(np.isfinite(val))
        return rows, cols[rows], val[rows]
    low = _kth(s, k)
    flat = np.flatnonzero((s <= low[:, None]) & (s < np.inf))
    rows, cols = np.divmod(flat, max(1, s.shape[1]))
    return _first_k(rows, cols, s[rows, cols], k)


def nearest_pairs(x: np.ndarray, y: np.ndarray, metric: str, k: int = 1,
                  apart: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest y of every x, ties to the earlier y.

    ``apart`` tells for a slice of x which pairs must not match. Long vectors are ranked by matrix products first, and whatever lies
    within their rounding error of the k-th best is then measured as ``pair_distances`` does.
    """
    out, strip = [], max(1, 4_000_000 // max(1, len(y)))
    products = metric == "l2" and x.shape[1] > TREE_DIMS
    if products:
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        slack = (x.shape[1] + 16) * 8 * np.finfo(float).eps * (xx + yy.max(initial=0.0))
        products = bool(np.isfinite(slack).all())
    for at in range(0, len(x), strip):
        part = slice(at, at + strip)
        if not products:
            s = pair_distances(x[part], y, metric)
            if apart is not None:
                s[apart(part)] = np.inf
            rows, cols, val = smallest(s, k)
        else:
            s = x[part] @ y.T
            s *= -2.0
            s += yy
            if apart is not None:
                s[apart(part)] = np.inf
            top = _kth(s, k) + 2 * slack[part]
            flat = np.flatnonzero((s <= top[:, None]) & (s < np.inf))
            rows, cols = np.divmod(flat, max(1, len(y)))
            val = np.empty(len(rows))
            for c in range(0, len(rows), 65_536):
                d = x[part][rows[c : c + 65_536]] - y[cols[c : c + 65_536]]
                val[c : c + 65_536] = np.sqrt(np.einsum("ij,ij->i", d, d))
            rows, cols, val = _first_k(rows, cols, val, k)
        out.append((rows + at, cols, val))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


class Cells:
    """Leaves of a k-d tree over a sample of points; ``fit`` gives them the boxes of all rows placed in them."""

    def __init__(self, sample: np.ndarray, depth: int):
        pts = sample[None, : len(sample) >> depth << depth]
        self.depth, self.leaves = depth, 1 << depth
        self.axis, self.cut = np.zeros(2 * self.leaves, int), np.zeros(2 * self.leaves)
        for level in range(depth):
            n, half = 1 << level, pts.shape[1] // 2
            axis = (pts.max(1) - pts.min(1)).argmax(1)
            key = np.take_along_axis(pts, axis[:, None, None], 2)[:, :, 0]
            order = key.argsort(1, kind="stable")
            pts, key = np.take_along_axis(pts, order[:, :, None], 1), np.take_along_axis(key, order, 1)
            more = np.where(key > key[:, :1], key, np.inf).min(1)  # a cut at the least value leaves one side empty
            self.axis[n : 2 * n] = axis
            self.cut[n : 2 * n] = np.where((key[:, half] == key[:, 0]) & np.isfinite(more), more, key[:, half])
            pts = pts.reshape(2 * n, half, -1)
        self.sample = pts

    def place(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.axis[node]] >= self.cut[node])
        return node - self.leaves

    def fit(self, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.hi = np.full((2 * self.leaves, lo.shape[1]), np.inf), np.full((2 * self.leaves, lo.shape[1]), -np.inf)
        self.lo[self.leaves + cell], self.hi[self.leaves + cell] = lo, hi
        for n in range(self.leaves - 1, 0, -1):
            self.lo[n], self.hi[n] = np.minimum(self.lo[2 * n], self.lo[2 * n + 1]), np.maximum(self.hi[2 * n], self.hi[2 * n + 1])

    def upper(self, x: np.ndarray, k: int, metric: str) -> np.ndarray:
        """No smaller than the distance of the k-th nearest row: that of the k-th nearest in the leaf's sample."""
        own = self.sample[self.place(x)]
        if own.shape[1] < k:
            return np.full(len(x), np.inf)
        return np.partition(_norm(own - x[:, None], metric), k - 1, axis=1)[:, k - 1]

    def meeting(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray | None = None, metric: str = "linf") -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the leaves with rows whose box comes within ``limit`` (0) of the box of a row."""
        row, node = np.arange(len(lo)), np.ones(len(lo), int)
        for level in range(self.depth + 1):
            if level:
                row, node = np.repeat(row, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            full = self.lo[node, 0] < np.inf
            row, node = row[full], node[full]
            gap = _norm(np.maximum(np.maximum(self.lo[node] - hi[row], lo[row] - self.hi[node]), 0.0), metric)
            near = gap <= (0.0 if limit is None else limit[row])
            row, node = row[near], node[near]
        order = np.argsort(row, kind="stable")
        return row[order], node[order] - self.leaves


def _norm(d: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(np.einsum("...k,...k->...", d, d))
    return np.abs(d).sum(-1) if metric == "l1" else np.abs(d).max(-1)


def sampled_cells(points: DataFrame, vec: str, rows: int, per_leaf: int = LEAF_SAMPLE) -> Cells:
    """A tree over up to MAX_LEAVES * per_leaf of ``rows`` points, with leaves of about LEAF_ROWS of them."""
    depth = int(min(MAX_LEAVES, max(1, rows // max(LEAF_ROWS, per_leaf)))).bit_length() - 1
    some = points.orderBy(F.xxhash64(vec)).limit(per_leaf << depth).select(vec).toPandas()[vec]
    return Cells(stack(some, "l2"), depth)


def fit_cells(cells: Cells, points: DataFrame, vec: str) -> DataFrame:
    """``points`` with their ``cell``, written; the tree learns the leaves' boxes."""
    dims = cells.sample.shape[2]

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(cells.place(stack(v, "l2")).astype("int32"))

    placed = written(points.withColumn("cell", place(vec)), "placed")
    ends = [f(F.col(vec)[i].cast("double")).alias(f"{n}{i}") for f, n in ((F.min, "lo"), (F.max, "hi")) for i in range(dims)]
    box = placed.groupBy("cell").agg(*ends).toPandas()  # one row per leaf
    cells.fit(box["cell"].to_numpy(), *(box[[f"{n}{i}" for i in range(dims)]].to_numpy(float) for n in ("lo", "hi")))
    return placed


def _block_counts(df: DataFrame, on: Sequence[str], rows: int, name: str) -> DataFrame:
    return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))


def block_best(
    needles: DataFrame,
    hay: DataFrame,
    needle_id: str,
    hay_id: str,
    score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int = 1,
    on: Sequence[str] = (),
    block_rows: int | tuple[int, int] = BLOCK_ROWS,
    few: bool = False,
) -> DataFrame:
    """(on, needle_id, rank, hay_id, score) with the k smallest finite scores, ties to lower hay_id.

    ``score`` gets one block of each side, the second in order of hay_id, and returns a matrix where inf means "no match", or the k best as
    (row, column, value). ``block_rows`` may name a size for either side. ``few`` says that the groups of ``on`` are bounded in number.
    """
    mine, other = block_rows if isinstance(block_rows, tuple) else (block_rows, block_rows)
    on = list(on)
    keys = on or ["__all"]
    if not on:
        needles, hay = needles.withColumn("__all", F.lit(0)), hay.withColumn("__all", F.lit(0))
    # fresh column ids: both sides may come from one table
    needles = needles.select(*[F.col(c).alias(c) for c in needles.columns])
    hay = hay.select(*[F.col(c).alias(c) for c in hay.columns])
    counts = _block_counts(needles, keys, mine, "__nb").join(_block_counts(hay, keys, other, "__hb"), keys)
    if few or not on:
        counts = F.broadcast(counts)
    n_cols, h_cols = needles.columns, hay.columns

    def spread(df: DataFrame, ident: str, blocks: str, across: str, own: str, fan: str) -> DataFrame:
        return (
            df.join(counts, keys)
            .withColumn(own, F.pmod(F.xxhash64(F.col(ident)), F.col(blocks)).cast("int"))
            .withColumn(fan, F.explode(F.sequence(F.lit(0), F.col(across) - 1)))
        )

    nn = spread(needles, needle_id, "__nb", "__hb", "__i", "__j").select(*n_cols, "__i", "__j")
    hh = spread(hay, hay_id, "__hb", "__nb", "__j", "__i").select(*h_cols, "__i", "__j")
    id_n, id_h = needles.schema[needle_id].dataType, hay.schema[hay_id].dataType
    key_fields = [needles.schema[c] for c in keys]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in key_fields]
        + [T.StructField(needle_id, id_n), T.StructField("hay_id", id_h), T.StructField("score", T.DoubleType())]
    )
    names = [f.name for f in schema.fields]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in names})
        b = b.sort_values(hay_id, kind="stable").reset_index(drop=True)
        s = score(a, b)
        rows, cols, val = s if isinstance(s, tuple) else smallest(np.asarray(s, dtype=np.float64), k)
        out = {c: a[c].to_numpy()[rows] for c in keys}
        out[needle_id] = a[needle_id].to_numpy()[rows]
        out["hay_id"] = b[hay_id].to_numpy()[cols]
        out["score"] = val
        return pd.DataFrame(out)[names]

    group = [*keys, "__i", "__j"]
    part = nn.groupBy(*group).cogroup(hh.groupBy(*group)).applyInPandas(best, schema)
    return _merge_best(part, [*on, needle_id], k)


def _merge_best(part: DataFrame, by: list[str], k: int) -> DataFrame:
    if k == 1:
        best = part.groupBy(*by).agg(F.min(F.struct("score", "hay_id")).alias("__best"))
        return best.select(*by, F.lit(1).alias("rank"), F.col("__best.hay_id").alias("hay_id"), F.col("__best.score").alias("score"))
    w = W.partitionBy(*by).orderBy("score", "hay_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "rank", "hay_id", "score")


def measurable(df: DataFrame, vec: str) -> Column:
    holds = df.schema[vec].dataType
    ok = F.col(vec).isNotNull()
    if isinstance(holds, T.ArrayType):
        # NaN counts as above infinity, so one comparison keeps finite components only
        ok = ok & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return ok


def knn_join(
    needles: DataFrame,
    hay: DataFrame,
    needle_id: str,
    hay_id: str,
    vec: str,
    k: int = 1,
    metric: str = "l2",
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest hay rows of every needle: (needle_id, rank, hay_id, score).

    Where copies of one vector pile up, only k of them stand for the hay side (the lowest ids win
    ties anyway) and one for the needles, whose result is then handed to all copies.
    Vectors that are NULL or hold a NULL or NaN have no distance and take no part on either side.
    """
    needles, hay = needles.where(measurable(needles, vec)), hay.where(measurable(hay, vec))
    needles = needles.select(needle_id, vec).withColumn("__vh", F.xxhash64(vec))
    hay = hay.select(hay_id, vec).withColumn("__vh", F.xxhash64(vec))
    if _repeats(hay):
        w = W.partitionBy("__vh", vec).orderBy(hay_id)
        hay = hay.withColumn("__c", F.row_number().over(w)).where(F.col("__c") <= k)
    hay = hay.select(hay_id, vec)
    if _repeats(needles):
        rep = written(needles.groupBy("__vh", vec).agg(F.min(needle_id).alias("__rep")), "vectors")
        found = _knn(rep.select("__rep", vec), hay, "__rep", hay_id, vec, k, metric, pivots, block_rows)
        # k result rows per representative: packed to one, so that the lookup stays one row per key
        packed = found.groupBy("__rep").agg(F.collect_list(F.struct("rank", "hay_id", "score")).alias("__l"))
        lookup = rep.join(packed.hint("merge"), "__rep").drop("__rep").hint("merge")
        out = salted_lookup(needles, lookup, "__vh", heavy=heavy_keys(needles, "__vh"), also=(vec,))
        return out.select(needle_id, F.explode("__l").alias("__r")).select(needle_id, "__r.rank", "__r.hay_id", "__r.score")
    return _knn(needles.select(needle_id, vec), hay, needle_id, hay_id, vec, k, metric, pivots, block_rows)


def _repeats(df: DataFrame) -> bool:
    """Whether half of the vectors or more are copies, or one vector has a large share."""
    counts = df.groupBy("__vh").agg(F.count(F.lit(1)).alias("n"))
    total, kinds, most = counts.agg(F.sum("n"), F.count("n"), F.max("n")).first()
    return kinds > 0 and (2 * kinds <= total or most > max(1000.0, total * HEAVY_SHARE))


def _knn(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, vec: str, k: int, metric: str, pivots: int | None, block_rows: int) -> DataFrame:
    if metric != "hamming" and (first := hay.select(vec).first()) is not None and len(first[0]) <= TREE_DIMS:
        return _tree_knn(needles, hay, needle_id, hay_id, vec, k, metric, block_rows)
    blocks = (8 * block_rows, 2 * block_rows)  # the matrix products take the pairs of a block in strips
    if pivots is None:
        pivots = min(MAX_PIVOTS, 1 + hay.count() // blocks[1])
    rows = hay.orderBy(F.xxhash64(hay_id), hay_id).limit(min(pivots, MAX_PIVOTS)).select(vec).collect()
    if not rows:
        return block_best(needles, hay, needle_id, hay_id, lambda a, b: np.zeros((len(a), len(b))), k)
    piv = stack(pd.Series([r[0] for r in rows]), metric)

    @F.pandas_udf("struct<cell:int,r:double>")
    def home(v: pd.Series) -> pd.DataFrame:
        x, cells, radius = stack(v, metric), [], []
        for s in range(0, len(x), STRIP):
            d = pair_distances(x[s : s + STRIP], piv, metric)
            cells.append(d.argmin(1))
            radius.append(d.min(1))
        return pd.DataFrame({"cell": np.concatenate(cells).astype("int32"), "r": np.concatenate(radius)})

    placed = written(hay.withColumn("__h", home(vec)).select(hay_id, vec, F.col("__h.cell").alias("cell"), F.col("__h.r").alias("r")), "placed")
    w = W.partitionBy("cell").orderBy("r")
    closest = placed.select("cell", "r").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    facts = placed.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    near = closest.collect()  # at most k rows per pivot
    m = len(piv)
    lo, hi = np.full(m, np.inf), np.full(m, -np.inf)
    radii = np.full((m, k), np.inf)
    for f in facts:
        lo[f.cell], hi[f.cell] = f.lo, f.hi
    for f in near:
        radii[f.cell, f.n - 1] = f.r

    @F.pandas_udf("array<int>")
    def reachable(v: pd.Series) -> pd.Series:
        x, out = stack(v, metric), []
        for s in range(0, len(x), STRIP):
            d = pair_distances(x[s : s + STRIP], piv, metric)
            # k-th smallest of "through the pivot" distances bounds the k-th nearest from above
            upper = np.partition((d[:, :, None] + radii[None]).reshape(len(d), -1), k - 1, axis=1)[:, k - 1]
            lower = np.maximum(np.maximum(d - hi[None], lo[None] - d), 0.0)
            ok = lower <= (upper + 1e-9 * (1.0 + np.where(np.isfinite(upper), upper, 0.0)))[:, None]
            ok &= np.isfinite(lo)[None]
            out += [np.nonzero(o)[0].astype("int32") for o in ok]
        return pd.Series(out)

    routed = needles.withColumn("cell", F.explode(reachable(vec)))

    per_cell = block_best(routed, placed.drop("r"), needle_id, hay_id, vector_score(vec, metric, k), k, ["cell"], blocks, few=True)
    return _merge_best(per_cell.drop("cell", "rank"), [needle_id], k)


def vector_score(vec: str, metric: str, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return lambda a, b: nearest_pairs(stack(a[vec], metric), stack(b[vec], metric), metric, k)


def _tree_knn(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, vec: str, k: int, metric: str, block_rows: int) -> DataFrame:
    """The leaf sample bounds the k-th distance from above; needles meet the leaves whose boxes are no farther."""
    hay = written(hay, "hay")
    cells = sampled_cells(hay, vec, hay.count(), max(LEAF_SAMPLE, k))
    placed = fit_cells(cells, hay, vec)

    @F.pandas_udf("array<int>")
    def reachable(v: pd.Series) -> pd.Series:
        x, out = stack(v, metric), []
        for s in range(0, len(x), 8192):
            part = x[s : s + 8192]
            upper = cells.upper(part, k, metric)
            row, cell = cells.meeting(part, part, upper + 1e-9 * (1.0 + np.where(np.isfinite(upper), upper, 0.0)), metric)
            out += np.split(cell.astype("int32"), np.searchsorted(row, np.arange(1, len(part))))
        return pd.Series(out)

    routed = needles.withColumn("cell", F.explode(reachable(vec)))
    per_cell = block_best(routed, placed, needle_id, hay_id, vector_score(vec, metric, k), k, ["cell"], block_rows, few=True)
    return _merge_best(per_cell.drop("cell", "rank"), [needle_id], k)


def mutual_nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec: str, metric: str = "l2", **kw) -> DataFrame:
    """Pairs that are each other's nearest row: (a_id, b_id, score)."""
    fwd = written(knn_join(a, b, a_id, b_id, vec, 1, metric, **kw).select(a_id, F.col("hay_id").alias(b_id), "score"), "forward")
    asked = b.join(fwd.select(b_id).distinct().hint("merge"), b_id, "left_semi")  # no other row can be in a mutual pair
    back = knn_join(asked, a, b_id, a_id, vec, 1, metric, **kw).select(F.col("hay_id").alias(a_id), b_id)
    return fwd.join(back.hint("merge"), [a_id, b_id])


def lowe_ratio(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, vec: str, ratio: float = 0.85,
               metric: str = "l2", **kw) -> DataFrame:
    """Best match kept where it is clearly closer than the second best."""
    two = knn_join(needles, hay, needle_id, hay_id, vec, 2, metric, **kw)
    g = two.groupBy(needle_id).agg(
        F.min_by("hay_id", "rank").alias("hay_id"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("d2"),
    )
    return g.where(F.col("d1") < F.lit(ratio) * F.col("d2"))
