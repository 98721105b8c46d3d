"""Relative pose of two views from correspondences with outliers, for any number of view pairs at once.

Samples come from a pool: the rows of a pair with the smallest seeded hash, kept by a map-side limited ranking. The pool is
bounded, so a pair's trials are drawn, solved and ranked together in one Arrow group, as many as its own inlier share asks for.
The few best essential matrices are then judged by all rows, refitted on all inliers by grouped sums and split into
rotation and direction by a vote of all inliers. No row is repeated per trial.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from navlytics.functions import computed, rotations as R
from navlytics.functions import vectors as V
from navlytics.operators.skew import heavy_keys, salted_lookup
from navlytics.plans.adjust import epipolar_error, essential_matrix
from navlytics.session import cut_lineage

SAMPLE = 8
#: Trials drawn and solved together.
_BLOCK = 64
_XY = ("x0", "y0", "x1", "y1")


def _essentials(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """(trials, 3, 3) of samples (trials, SAMPLE, 3): null vector of the linear system with singular values (1, 1, 0)."""
    system = (x1[..., :, None] * x0[..., None, :]).reshape(*x0.shape[:2], 9)
    e = np.linalg.svd(system, full_matrices=True)[2][:, -1].reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(e)
    return u[:, :, :2] @ vt[:, :2, :]


def _distances(e: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """(trials, rows) first-order distances of rows (rows, 3) from the epipolar constraints."""
    a, b = np.ascontiguousarray(x0.T), np.ascontiguousarray(x1.T)  # one plain product per component of the lines
    u, v, w = (e[:, i] @ a for i in range(3))
    size = u * u
    size += v * v
    for j in (0, 1):
        line = e[:, :, j] @ b
        size += line * line
    u *= b[0]
    v *= b[1]
    w *= b[2]
    u += v
    u += w
    np.sqrt(size, out=size)
    return np.abs(u, out=u) / np.maximum(size, 1e-300, out=size)


def trials_needed(inliers: int, n: int, confidence: float) -> float:
    """Draws of SAMPLE of n rows until one has inliers only with ``confidence``; one such sample is assumed to exist."""
    some = max(inliers, SAMPLE)
    clean = np.prod([(some - i) / (n - i) for i in range(SAMPLE)])
    return 1.0 if clean >= 1 else float(np.ceil(np.log1p(-confidence) / np.log1p(-clean)))


def _candidates(by: str, max_err: float, keep: int, confidence: float, max_trials: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def solve(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("__r")
        one = np.ones(len(pool))
        x0, x1 = (np.stack([pool[f"x{i}"], pool[f"y{i}"], one], axis=1) for i in (0, 1))
        rng, done, need, best = np.random.default_rng(seed), 0, 1.0, []
        while done < min(need, max_trials):
            # the smallest of random keys per trial are a draw without repetition
            picks = rng.random((_BLOCK, len(pool))).argpartition(SAMPLE - 1, axis=1)[:, :SAMPLE]
            e = _essentials(x0[picks], x1[picks])
            votes = (_distances(e, x0, x1) < max_err).sum(1)
            top = np.argsort(-votes, kind="stable")[:keep]
            best = sorted([*best, *((-votes[i], done + i, e[i].ravel().tolist()) for i in top)], key=lambda b: b[:2])[:keep]
            done += _BLOCK
            need = trials_needed(-best[0][0], len(pool), confidence)
        return pd.DataFrame({by: pool[by].iloc[:1].to_numpy(), "es": [[b[2] for b in best]], "trials": [done], "confident": [bool(done >= need)]})

    return solve


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def split_essential(e: pd.Series) -> pd.Series:
    """The two rotations (nine numbers each) and the unit direction that an essential matrix allows."""
    u, _, vt = np.linalg.svd(np.vstack(e.to_numpy()).reshape(-1, 3, 3))
    u = u * np.where(np.linalg.det(u) < 0, -1.0, 1.0)[:, None, None]
    vt = vt * np.where(np.linalg.det(vt) < 0, -1.0, 1.0)[:, None, None]
    quarter = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    return pd.Series(list(np.concatenate([(u @ quarter @ vt).reshape(-1, 9), (u @ quarter.T @ vt).reshape(-1, 9), u[:, :, 2]], axis=1)))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def with_depths(d: DataFrame, turned: list[str], t: list[str], z0: str, z1: str) -> DataFrame:
    """``d`` (x1, y1 and others) with the depths of a correspondence in both views, in baselines, as ``z0`` and ``z1``. NULL without parallax.

    ``turned`` names the first view's ray in the second's axes, ``t`` the direction; the cross products are worked out once.
    """
    ray, shift, seen = [F.col(c) for c in turned], [F.col(c) for c in t], [F.col("x1"), F.col("y1"), F.lit(1.0)]
    d = computed(d, **{f"__c{i}": c for i, c in enumerate(_cross(seen, ray))})
    c = [F.col(f"__c{i}") for i in range(3)]
    d = computed(d, __size=_dot(c, c), __z0=-_dot(_cross(seen, shift), c), __z1=-_dot(_cross(ray, shift), c))
    d = d.withColumns({z0: F.try_divide("__z0", "__size"), z1: F.try_divide("__z1", "__size")})
    return d.drop("__c0", "__c1", "__c2", "__size", "__z0", "__z1")


def _in_front(max_depth: float) -> list[Column]:
    """Whether a row lies before both cameras, for the rotations and directions (1, +), (1, -), (2, +), (2, -), by its depths z01, z11, z02, z12."""
    out = []
    for z0, z1 in ((F.col("z01"), F.col("z11")), (F.col("z02"), F.col("z12"))):
        out += [(s * z0 > 0) & (s * z1 > 0) & (s * z0 < max_depth) & (s * z1 < max_depth) for s in (1.0, -1.0)]
    return [F.coalesce(c, F.lit(False)) for c in out]


def _turned(r: Column, first: int, name: str) -> dict[str, Column]:
    """The first view's ray turned by the nine numbers of an array from ``first`` on, a column per component."""
    return {f"{name}{i}": r[first + 3 * i] * F.col("x0") + r[first + 3 * i + 1] * F.col("y0") + r[first + 3 * i + 2] for i in range(3)}


def relative_poses(pairs: DataFrame, by: str, ident: str, max_err: float, min_inliers: int = 15, min_front: float = 0.75, max_depth: float = 50.0,
                   pool: int = 512, keep: int = 4, confidence: float = 0.999, max_trials: int = 20_000, seed: int = 7) -> DataFrame:
    """(by, e, quat, dir, n, inliers, front, trials, confident, ok): pose of the second view of each pair relative to the first.

    ``pairs`` has rows (by, ident, x0, y0, x1, y1) in normalised image coordinates; a point p of the first view is
    quat p + scale * dir in the second. Inliers are closer than ``max_err`` to the epipolar constraint; ``front`` counts those
    before both cameras and less than ``max_depth`` baselines away. ``ok`` asks for ``min_inliers`` inliers, more than that
    many in front, and a share of the inliers in front of at least ``min_front``. ``confident`` says whether enough trials
    were drawn for ``confidence`` within ``max_trials``.

    Rows with a null pair or null or non-finite coordinates take no part; pairs with less than 8 other rows have no result.
    Repeated rows count as often as they occur. Ties among trials go to the earlier, among the four poses to the first.
    An empty table gives an empty result. Columns besides those named are not read.
    """
    xy = [F.col(c).cast("double") for c in _XY]
    rows = pairs.select(by, ident, *[c.alias(n) for c, n in zip(xy, _XY)]).where(F.col(by).isNotNull())
    rows = cut_lineage(rows.where(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('infinity')" for c in _XY)))  # NaN is above infinity
    heavy = heavy_keys(rows, by)

    order = W.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), ident, *_XY), ident, *_XY)
    drawn = rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= pool)
    drawn = drawn.select(by, *_XY, "__r", F.count(F.lit(1)).over(W.partitionBy(by)).alias("__n")).where(F.col("__n") >= SAMPLE)
    kind = dict(rows.dtypes)[by]
    found = cut_lineage(drawn.groupBy(by).applyInPandas(
        _candidates(by, max_err, keep, confidence, max_trials, seed), f"`{by}` {kind}, es array<array<double>>, trials long, confident boolean"))

    def inlier(e: Column) -> Column:
        return F.coalesce(epipolar_error(e, *[F.col(c) for c in _XY]) < max_err, F.lit(False))

    # a failed size of list element is NULL and counts nothing
    votes = salted_lookup(rows, found.select(by, "es"), by, heavy=heavy)
    votes = votes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(inlier(F.get("es", F.lit(i)))).alias(f"v{i}") for i in range(keep)])
    ranked = F.array_max(F.array(*[F.struct(F.col(f"v{i}").alias("votes"), F.lit(-i).alias("minus")) for i in range(keep)]))
    first = found.join(votes.select(by, "n", ranked.alias("top")), by)
    first = cut_lineage(first.select(by, F.get("es", -F.col("top.minus")).alias("e"), "n", F.col("top.votes").alias("inliers"), "trials", "confident"))

    near = salted_lookup(rows, first.select(by, "e"), by, heavy=heavy).where(inlier(F.col("e"))).drop("e")
    refit = cut_lineage(essential_matrix(near, [by]).select(by, F.col("e").alias("e2")))
    again = salted_lookup(rows, refit, by, heavy=heavy).groupBy(by).agg(F.count_if(inlier(F.col("e2"))).alias("inliers2"))
    best = first.join(refit, by, "left").join(again, by, "left").withColumn("better", F.coalesce(F.col("inliers2") >= F.col("inliers"), F.lit(False)))
    best = best.select(by, F.when(F.col("better"), F.col("e2")).otherwise(F.col("e")).alias("e"), "n",
                       F.when(F.col("better"), F.col("inliers2")).otherwise(F.col("inliers")).alias("inliers"), "trials", "confident")
    best = cut_lineage(best.withColumn("rt", split_essential("e")))

    d = salted_lookup(rows, best.select(by, "e", "rt"), by, heavy=heavy).where(inlier(F.col("e")))
    rt, shift = F.col("rt"), ["t0", "t1", "t2"]
    d = computed(d.select(by, *_XY, "rt"), **_turned(rt, 0, "a"), **_turned(rt, 9, "b"), t0=rt[18], t1=rt[19], t2=rt[20])
    d = d.select(by, "x1", "y1", *[f"{v}{i}" for v in "abt" for i in range(3)])
    d = with_depths(with_depths(d, ["a0", "a1", "a2"], shift, "z01", "z11"), ["b0", "b1", "b2"], shift, "z02", "z12")
    front = d.groupBy(by).agg(*[F.count_if(c).alias(f"f{i}") for i, c in enumerate(_in_front(max_depth))])
    four = F.array_max(F.array(*[F.struct(F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("votes"), F.lit(-i).alias("minus")) for i in range(4)]))
    out = best.join(front, by, "left").withColumn("four", four)
    second, sign = F.col("four.minus") <= -2, F.when(F.col("four.minus") % 2 == 0, 1.0).otherwise(-1.0)
    rot = F.when(second, F.slice(rt, 10, 9)).otherwise(F.slice(rt, 1, 9))
    ok = (F.col("inliers") >= min_inliers) & (F.col("four.votes") > min_inliers) & (F.col("four.votes") >= min_front * F.col("inliers"))
    # written, since the quaternion reads every element of the rotation many times
    out = cut_lineage(out.select(by, "e", rot.alias("rot"), V.vec(sign * rt[18], sign * rt[19], sign * rt[20]).alias("dir"), "n", "inliers",
                                 F.col("four.votes").alias("front"), "trials", "confident", ok.alias("ok")))
    return out.select(by, "e", R.from_matrix(F.col("rot")).alias("quat"), "dir", "n", "inliers", "front", "trials", "confident", "ok")


def keypoint_counters(pairs: DataFrame, poses: DataFrame, by: str, ident: str, max_err: float, max_depth: float = 50.0) -> DataFrame:
    """(ident, total_count, inlier_count, inlier_in): in how many solved pairs a keypoint was seen and agreed, and the greatest pair it agreed in.

    ``poses`` comes from ``relative_poses``; pairs that are not ok count nothing. A keypoint agrees if it is an inlier in front of both cameras;
    one with null or non-finite coordinates is seen and does not agree. Keypoints of no solved pair have no row.
    """
    m = R.matrix(F.col("quat"))
    good = poses.where("ok").select(by, "e", m.alias("r"), F.array("dir.x", "dir.y", "dir.z").alias("t"))
    d = salted_lookup(pairs.select(by, ident, *_XY), good, by)
    t = {f"t{i}": F.col("t")[i] for i in range(3)}
    d = computed(d, **_turned(F.col("r"), 0, "a"), **t, close=epipolar_error(F.col("e"), *[F.col(c) for c in _XY]) < max_err)
    d = with_depths(d.select(by, ident, "close", "x1", "y1", *[f"{v}{i}" for v in "at" for i in range(3)]), ["a0", "a1", "a2"], [*t], "z0", "z1")
    close, z0, z1 = F.col("close"), F.col("z0"), F.col("z1")
    agrees = F.coalesce(close & (z0 > 0) & (z1 > 0) & (z0 < max_depth) & (z1 < max_depth), F.lit(False))
    return d.groupBy(ident).agg(F.count(F.lit(1)).alias("total_count"), F.count_if(agrees).alias("inlier_count"), F.max(F.when(agrees, F.col(by))).alias("inlier_in"))
