"""Camera calibration: intrinsics and distortion of many cameras, solved together with the poses of all their frames.

The normal equations of a camera are an arrowhead: a 6x6 block per frame and a border of a few columns for the intrinsics that all
its frames share. Frames are eliminated first, each on its own; what they leave is summed per camera into one small system; the
frames' steps follow by back substitution. A frame is one row: the sums of products of its residuals and Jacobian columns. Steps are damped and accepted per
camera, so one call calibrates any number of cameras, and cameras that are done take no further part.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from navlytics.functions import rotations as R
from navlytics.functions import vectors as V
from navlytics.functions.camera import huber_weight
from navlytics.operators.skew import heavy_keys, salted_lookup
from navlytics.plans.adjust import Settings, step_poses
from navlytics.session import discard, free_shuffles, is_written, written

#: Columns of a camera table; the distortion terms are two radial, then two tangential ones.
PARAMETERS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")
#: Root mean square residual (px) at which nothing is left to gain.
EXACT_PX = 1e-6
#: Most views that a frame may have for all of them to lie in one row; of those, about so many are worked on at a time.
GATHERED, SLICE = 20_000, 1 << 16
#: Cameras whose numbers go to every task.
FEW_CAMERAS = 1000
_ARRAY = T.ArrayType(T.DoubleType())


@dataclass
class Calibration:
    """``cams``: cam_id, PARAMETERS, cost, n_obs, rms_px, converged. ``poses``: frame_id, cam_id, rot, loc."""

    cams: DataFrame
    poses: DataFrame
    rounds: int


def residual_rows(obs: DataFrame, poses: DataFrame, points: DataFrame, cams: DataFrame, free: tuple[str, ...], s: Settings,
                  heavy: tuple[list, list, list] = ([], [], [])) -> DataFrame:
    """(cam_id, frame_id, w): per view two lists of 6 pose columns, the free intrinsics' columns and the residual, weighted.

    Views of points that are not in front of the camera are left out.
    """
    d = salted_lookup(obs, poses, "frame_id", heavy=heavy[0])
    d = salted_lookup(d, points.select("kp_id", "pt"), "kp_id", heavy=heavy[1])
    d = salted_lookup(d, cams.select("cam_id", *PARAMETERS), "cam_id", heavy=heavy[2])
    d = d.withColumn("rx", R.rotate_point(F.col("rot"), F.col("pt")))
    d = d.withColumn("xc", V.add(F.col("rx"), F.col("loc"))).where("xc.z > 0")
    z = F.col("xc.z")
    d = d.withColumns({"x": F.col("xc.x") / z, "y": F.col("xc.y") / z})
    x, y, k1, k2, p1, p2 = (F.col(c) for c in ("x", "y", "k1", "k2", "p1", "p2"))
    d = d.withColumn("r2", x * x + y * y)
    r2 = F.col("r2")
    d = d.withColumns({"rad": 1 + r2 * (k1 + r2 * k2), "g": k1 + 2 * k2 * r2})
    rad, g = F.col("rad"), F.col("g")
    d = d.withColumns({
        "xd": x * rad + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), "yd": y * rad + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y,
        "dxx": rad + 2 * x * x * g + 2 * p1 * y + 6 * p2 * x, "dyy": rad + 2 * y * y * g + 6 * p1 * y + 2 * p2 * x,
        "dxy": 2 * x * y * g + 2 * p1 * x + 2 * p2 * y})
    fx, fy = F.col("fx") / s.px_sd, F.col("fy") / s.px_sd
    d = d.withColumns({"eu": (F.col("u") - F.col("cx")) / s.px_sd - fx * F.col("xd"), "ev": (F.col("v") - F.col("cy")) / s.px_sd - fy * F.col("yd")})
    d = d.withColumns({"k": huber_weight(F.hypot("eu", "ev"), s.huber_px),
                       "a0": -fx * F.col("dxx") / z, "a1": -fx * F.col("dxy") / z, "b0": -fy * F.col("dxy") / z, "b1": -fy * F.col("dyy") / z})
    zero = F.lit(0.0)
    own = {
        "fx": (-F.col("xd") / s.px_sd, zero), "fy": (zero, -F.col("yd") / s.px_sd), "cx": (F.lit(-1 / s.px_sd), zero), "cy": (zero, F.lit(-1 / s.px_sd)),
        "k1": (-fx * x * r2, -fy * y * r2), "k2": (-fx * x * r2 * r2, -fy * y * r2 * r2),
        "p1": (-2 * fx * x * y, -fy * (r2 + 2 * y * y)), "p2": (-fx * (r2 + 2 * x * x), -2 * fy * x * y)}
    rows = []
    for i, (c0, c1, e) in enumerate((("a0", "a1", "eu"), ("b0", "b1", "ev"))):
        a, b = F.col(c0), F.col(c1)
        c = -(a * x + b * y)
        px, py, pz = (F.col(f"rx.{v}") for v in "xyz")
        line = [c * py - b * pz, a * pz - c * px, b * px - a * py, a, b, c, *[own[name][i] for name in free], F.col(e)]
        rows.append(F.array(*[F.col("k") * v for v in line]))
    return d.select("cam_id", "frame_id", F.array(*rows).alias("w"))


def frame_sums(rows: DataFrame, n: int) -> DataFrame:
    """(cam_id, frame_id, gram, views): upper triangle of the summed products of the n + 7 numbers of each row."""
    m, w = n + 7, F.col("w")
    tri = [(i, j) for i in range(m) for j in range(i, m)]
    g = rows.groupBy("cam_id", "frame_id").agg(
        F.count(F.lit(1)).alias("views"), *[F.sum(w[0][i] * w[0][j] + w[1][i] * w[1][j]).alias(f"g{k}") for k, (i, j) in enumerate(tri)])
    return g.select("cam_id", "frame_id", F.array(*[F.col(f"g{k}") for k in range(len(tri))]).alias("gram"), "views")


def _parts(gram: pd.Series, lam: pd.Series, n: int) -> tuple[np.ndarray, ...]:
    """Inverse damped pose block, its right-hand side, border, and the camera's own block and right-hand side, per frame."""
    m = n + 7
    flat = np.vstack(gram.to_numpy())
    g = np.zeros((len(flat), m, m))
    for k, (i, j) in enumerate((i, j) for i in range(m) for j in range(i, m)):
        g[:, i, j] = g[:, j, i] = flat[:, k]
    h = g[:, :6, :6].copy()
    i = np.arange(6)
    h[:, i, i] += lam.to_numpy(float)[:, None] * np.maximum(h[:, i, i], 1e-9)
    return np.linalg.pinv(h, hermitian=True), -g[:, :6, -1], g[:, :6, 6:-1], g[:, 6:-1, 6:-1], -g[:, 6:-1, -1]


def _reduced(n: int):
    @F.pandas_udf(_ARRAY)
    def reduced(gram: pd.Series, lam: pd.Series) -> pd.Series:
        """What a frame leaves for its camera: matrix, right-hand side, and the matrix's own diagonal before."""
        inv, b, border, c, own = _parts(gram, lam, n)
        t = border.transpose(0, 2, 1) @ inv
        left, right = c - t @ border, own - (t @ b[:, :, None])[:, :, 0]
        return pd.Series(list(np.hstack([left.reshape(-1, n * n), right, c[:, np.arange(n), np.arange(n)]])))

    return reduced


def _solved(n: int):
    @F.pandas_udf(_ARRAY)
    def solved(total: pd.Series, lam: pd.Series) -> pd.Series:
        """The camera's step; columns are scaled to one first, as a focal length and a distortion term differ by many orders."""
        x = np.vstack(total.to_numpy())
        a, b, diag = x[:, : n * n].reshape(-1, n, n).copy(), x[:, n * n : n * n + n], x[:, n * n + n :]
        scale = 1 / np.sqrt(np.maximum(diag, 1e-30))
        i = np.arange(n)
        a *= scale[:, :, None] * scale[:, None, :]
        a[:, i, i] += lam.to_numpy(float)[:, None]
        step = np.linalg.pinv(a, rcond=1e-13, hermitian=True) @ (b * scale)[:, :, None]
        return pd.Series(list(step[:, :, 0] * scale))

    return solved


def _back(n: int):
    @F.pandas_udf(_ARRAY)
    def back(gram: pd.Series, lam: pd.Series, dc: pd.Series) -> pd.Series:
        inv, b, border, _, _ = _parts(gram, lam, n)
        rest = b - (border @ np.vstack(dc.to_numpy())[:, :, None])[:, :, 0]
        return pd.Series(list((inv @ rest[:, :, None])[:, :, 0]))

    return back


def _start(cams: DataFrame, s: Settings) -> DataFrame:
    return written(cams.select("cam_id", *PARAMETERS).withColumns({
        "lam": F.lit(s.lam), "cost": F.lit(None).cast("double"), "n_obs": F.lit(0).cast("long"), "converged": F.lit(False)}))


def _first_costs(state: DataFrame, costs: DataFrame) -> DataFrame:
    return written(state.join(costs, "cam_id", "left").withColumns({
        "cost": F.col("new_cost"), "n_obs": F.coalesce("new_obs", F.lit(0)), "converged": F.col("new_cost").isNull()}).drop("new_cost", "new_obs"))


def _tried(state: DataFrame, step: DataFrame, free: tuple[str, ...]) -> DataFrame:
    """The cameras after their steps (cam_id, dc)."""
    tried = state.join(step, "cam_id", "left")
    return written(tried.withColumns({c: F.col(c) + F.coalesce(F.col("dc")[free.index(c)], F.lit(0.0)) for c in free}).drop("dc"))


def _verdict(j: DataFrame, free: tuple[str, ...], s: Settings) -> DataFrame:
    """Whether each camera takes its step, what follows from that, and whether it is done, from the tried cameras with new_cost and new_obs."""
    better = ~F.col("converged") & F.coalesce(F.col("new_cost") < F.col("cost"), F.lit(False)) & (F.col("new_obs") >= F.col("n_obs"))
    small = F.col("cost") - F.col("new_cost") <= s.ftol * F.col("cost")
    exact = 2 * F.col("new_cost") <= (EXACT_PX / s.px_sd) ** 2 * F.col("n_obs")
    return written(j.select(
        "cam_id", better.alias("ok"), F.when(better, F.greatest(F.lit(s.min_lam), F.col("lam") / 3)).otherwise(F.col("lam") * 10).alias("next_lam"),
        F.when(better, F.col("new_cost")).otherwise(F.col("cost")).alias("next_cost"), F.when(better, F.col("new_obs")).otherwise(F.col("n_obs")).alias("next_obs"),
        (F.col("converged") | (better & (small | exact)) | (~better & (F.col("lam") * 10 > s.max_lam))).alias("end"),
        *[F.col(c).alias(f"new_{c}") for c in free]))


def _next_state(state: DataFrame, verdict: DataFrame, free: tuple[str, ...]) -> DataFrame:
    return written(state.join(verdict, "cam_id").withColumns({
        **{c: F.when(F.col("ok"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in free},
        "lam": F.col("next_lam"), "cost": F.col("next_cost"), "n_obs": F.col("next_obs"), "converged": F.col("end")}).select(*state.columns))


def _by_rows(obs: DataFrame, poses: DataFrame, points: DataFrame, cams: DataFrame, free: tuple[str, ...], s: Settings) -> tuple[DataFrame, DataFrame, int]:
    """(state, poses, rounds): the solve by sums over rows of views, however many a frame has; the tables are joined again each round."""
    n = len(free)
    seen = salted_lookup(obs, poses.select("frame_id", "cam_id"), "frame_id")
    heavy = (heavy_keys(obs, "frame_id"), heavy_keys(obs, "kp_id"), heavy_keys(seen, "cam_id"))

    def sums(poses: DataFrame, cams: DataFrame) -> DataFrame:
        active = cams.where("NOT converged")
        own = salted_lookup(poses, active.select("cam_id"), "cam_id", heavy=heavy[2])
        return written(frame_sums(residual_rows(obs, own, points, active, free, s, heavy), n))

    def costs(grams: DataFrame) -> DataFrame:
        last = (n + 7) * (n + 8) // 2 - 1
        return grams.groupBy("cam_id").agg((0.5 * F.sum(F.col("gram")[last])).alias("new_cost"), F.sum("views").alias("new_obs"))

    state = _start(cams, s)
    grams = sums(poses, state)
    state = _first_costs(state, costs(grams))
    rounds = 0
    while rounds < s.max_iters and not state.where("NOT converged").isEmpty():
        rounds += 1
        damp = state.where("NOT converged").select("cam_id", "lam")
        work = salted_lookup(grams, damp, "cam_id", heavy=heavy[2])
        left = work.select("cam_id", "lam", _reduced(n)("gram", "lam").alias("r"))
        total = left.groupBy("cam_id", "lam").agg(*[F.sum(F.col("r")[i]).alias(f"r{i}") for i in range(n * n + 2 * n)])
        step = written(total.select("cam_id", _solved(n)(F.array(*[f"r{i}" for i in range(n * n + 2 * n)]), "lam").alias("dc")))
        moves = salted_lookup(work, step, "cam_id", heavy=heavy[2]).select("frame_id", _back(n)("gram", "lam", "dc").alias("p"))
        new_poses = written(step_poses(poses, moves).join(poses.select("frame_id", "cam_id"), "frame_id"))
        tried = _tried(state, step, free)
        new_grams = sums(new_poses, tried)
        verdict = _verdict(tried.join(costs(new_grams), "cam_id", "left"), free, s)
        ok = verdict.where("ok").select("cam_id")
        state = _next_state(state, verdict, free)
        choice = verdict.select("cam_id", "ok", "end")
        old = salted_lookup(grams, choice.where("NOT ok AND NOT end").select("cam_id"), "cam_id", heavy=heavy[2])
        grams = written(old.unionByName(salted_lookup(new_grams, choice.where("ok AND NOT end").select("cam_id"), "cam_id", heavy=heavy[2])))
        kept = poses.join(new_poses.select("frame_id", F.struct("rot", "loc").alias("__n")), "frame_id", "left")
        kept = salted_lookup(kept, ok.withColumn("__ok", F.lit(True)), "cam_id", "left", heavy=heavy[2])
        poses = written(kept.select("frame_id", "cam_id", *[F.when(F.col("__ok"), F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in ("rot", "loc")]))
    return state, poses, rounds


# ---- rounds over frames that hold their views --------------------------------------------------

_FRAME = "frame_id {f}, cam_id {c}, rot struct<x:double,y:double,z:double>, loc struct<x:double,y:double,z:double>, " \
    "rot1 struct<x:double,y:double,z:double>, loc1 struct<x:double,y:double,z:double>, views array<struct<u:double,v:double,x:double,y:double,z:double>>, s array<double>"


def _turned(rot: np.ndarray) -> np.ndarray:
    """(9, n) rotation matrices of (3, n) rotation vectors."""
    th = np.sqrt((rot * rot).sum(0))
    k = rot * np.where(th > 0, 1.0 / np.where(th > 0, th, 1.0), 0.0)
    c, sn = np.cos(th), np.sin(th)
    d = 1.0 - c
    x, y, z = k
    return np.stack([c + x * x * d, x * y * d - z * sn, x * z * d + y * sn, x * y * d + z * sn, c + y * y * d, y * z * d - x * sn,
                     x * z * d - y * sn, y * z * d + x * sn, c + z * z * d])


def _composed(adj: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Rotation vectors of (adj after base), both (3, n)."""
    q = []
    for v in (adj, base):
        th = np.sqrt((v * v).sum(0))
        q.append((np.cos(th / 2), v * np.where(th > 0, np.sin(th / 2) / np.where(th > 0, th, 1.0), 0.0)))
    (w0, a), (w1, b) = q
    im = w0 * b + w1 * a + np.cross(a, b, axis=0)
    norm = np.sqrt((im * im).sum(0))
    return im * np.where(norm > 0, 1.0 / np.where(norm > 0, norm, 1.0), 0.0) * 2.0 * np.arccos(np.clip(w0 * w1 - (a * b).sum(0), -1.0, 1.0))


def _view_sums(pose: np.ndarray, cam: np.ndarray, views: list[np.ndarray], blank: np.ndarray, at: np.ndarray, starts: np.ndarray, free: tuple[str, ...],
               s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """What ``frame_sums(residual_rows(...))`` says of each frame, as (sums, frames) and views.

    ``pose`` (6, frames), ``cam`` (8, frames), ``views`` u, v, x, y, z; ``at`` is a view's frame and ``starts`` a frame's first view. Views in ``blank`` lack a pixel coordinate: they have no residual.
    """
    u, v, *pt = views
    r = _turned(pose[:3])[:, at]
    px, py, pz = (r[3 * i] * pt[0] + r[3 * i + 1] * pt[1] + r[3 * i + 2] * pt[2] for i in range(3))
    tx, ty, tz = pose[3:, at]
    z = pz + tz
    front = ~(z <= 0)
    z = np.where(front, z, 1.0)
    x, y = (px + tx) / z, (py + ty) / z
    c = dict(zip(PARAMETERS, cam[:, at], strict=True))
    k1, k2, p1, p2 = c["k1"], c["k2"], c["p1"], c["p2"]
    fx, fy = c["fx"] / s.px_sd, c["fy"] / s.px_sd
    r2 = x * x + y * y
    rad, g = 1 + r2 * (k1 + r2 * k2), k1 + 2 * k2 * r2
    xd, yd = x * rad + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * rad + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    dxx, dyy = rad + 2 * x * x * g + 2 * p1 * y + 6 * p2 * x, rad + 2 * y * y * g + 6 * p1 * y + 2 * p2 * x
    dxy = 2 * x * y * g + 2 * p1 * x + 2 * p2 * y
    eu, ev = (np.where(blank, 0.0, err) for err in ((u - c["cx"]) / s.px_sd - fx * xd, (v - c["cy"]) / s.px_sd - fy * yd))
    e = np.hypot(eu, ev)
    k = np.where(e > s.huber_px, np.sqrt(s.huber_px / np.where(e > s.huber_px, e, 1.0)), 1.0)
    own = {
        "fx": (-xd / s.px_sd, 0.0), "fy": (0.0, -yd / s.px_sd), "cx": (-1 / s.px_sd, 0.0), "cy": (0.0, -1 / s.px_sd),
        "k1": (-fx * x * r2, -fy * y * r2), "k2": (-fx * x * r2 * r2, -fy * y * r2 * r2),
        "p1": (-2 * fx * x * y, -fy * (r2 + 2 * y * y)), "p2": (-fx * (r2 + 2 * x * x), -2 * fy * x * y)}
    m = len(free) + 7
    w = np.empty((2, m, len(at)))
    for i, (a, b, err) in enumerate(((-fx * dxx / z, -fx * dxy / z, eu), (-fy * dxy / z, -fy * dyy / z, ev))):
        cz = -(a * x + b * y)
        for j, line in enumerate([cz * py - b * pz, a * pz - cz * px, b * px - a * py, a, b, cz, *[own[name][i] for name in free], err]):
            np.multiply(k, line, out=w[i, j])
    w[:, :, ~front] = 0.0
    sums = np.stack([np.add.reduceat(w[0, i] * w[0, j] + w[1, i] * w[1, j], starts) for i in range(m) for j in range(i, m)])
    return sums, np.add.reduceat(front.astype(float), starts)


class _Eliminated:
    """Frames' pose blocks solved for their right-hand side ``xb`` and border ``xc``, all frames at once; a block that is singular in spite of its damping by pseudo-inverse."""

    def __init__(self, sums: np.ndarray, lam: np.ndarray, n: int):
        m = n + 7
        pos = {}
        for k, (i, j) in enumerate((i, j) for i in range(m) for j in range(i, m)):
            pos[i, j] = pos[j, i] = k
        a = sums[[pos[i, j] for i in range(6) for j in range(m)]].reshape(6, m, -1)
        a[:, -1] *= -1
        i = np.arange(6)
        a[i, i] += lam * np.maximum(a[i, i], 1e-9)
        self.border, self.b = a[:, 6:-1].copy(), a[:, -1].copy()
        self.c = sums[[pos[i, j] for i in range(6, m - 1) for j in range(6, m - 1)]].reshape(n, n, -1)
        self.own = -sums[[pos[i, m - 1] for i in range(6, m - 1)]]
        whole, least, weak = a.copy(), a[i, i] * 1e-13, np.zeros(a.shape[2], bool)
        with np.errstate(all="ignore"):
            for k in range(6):
                weak |= ~(a[k, k] > least[k])
                a[k, k + 1 :] /= a[k, k]
                for j in range(k + 1, 6):
                    a[j, k + 1 :] -= a[j, k] * a[k, k + 1 :]
            for k in range(4, -1, -1):
                for j in range(k + 1, 6):
                    a[k, 6:] -= a[k, j] * a[j, 6:]
        for f in np.flatnonzero(weak):
            if np.isfinite(whole[:, :, f]).all():
                a[:, 6:, f] = np.linalg.pinv(whole[:, :6, f], hermitian=True) @ whole[:, 6:, f]
        self.xc, self.xb = a[:, 6:-1], a[:, -1]

    def reduced(self) -> np.ndarray:
        """What frames leave for their camera, as ``_reduced`` gives it: (n * n + 2 n, frames)."""
        n = len(self.c)
        left = self.c - np.einsum("aif,ajf->ijf", self.border, self.xc)
        right = self.own - np.einsum("aif,af->if", self.border, self.xb)
        return np.concatenate([left.reshape(n * n, -1), right, self.c[np.arange(n), np.arange(n)]])

    def step(self, dc: np.ndarray) -> np.ndarray:
        return self.xb - np.einsum("aif,if->af", self.xc, dc)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE views each."""
    ends = np.cumsum(pc.list_value_length(b.column("views")).to_numpy(zero_copy_only=False))
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, side="right")))
        yield b.slice(first, last - first)
        first = last


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _pose(b: pa.RecordBatch, rot: str, loc: str) -> np.ndarray:
    return np.stack([_numbers(x) for c in (rot, loc) for x in b.column(c).flatten()])


def _vectors(b: pa.RecordBatch, name: str) -> np.ndarray:
    return _numbers(b.column(name).flatten()).reshape(b.num_rows, -1).T


def _views(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    size = pc.list_value_length(b.column("views")).to_numpy(zero_copy_only=False)
    flat = b.column("views").flatten().flatten()
    blank = flat[0].is_null().to_numpy(zero_copy_only=False) | flat[1].is_null().to_numpy(zero_copy_only=False)
    views = [np.where(blank, 0.0, _numbers(x)) if i < 2 else _numbers(x) for i, x in enumerate(flat)]
    return views, blank, np.repeat(np.arange(len(size)), size), np.cumsum(size) - size


def _add(totals: dict, cams: pa.Array, rows: np.ndarray) -> None:
    """Adds (sums, frames) to the totals of the frames' cameras."""
    coded = cams.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    for i, cam in enumerate(coded.dictionary.to_pylist()):
        own = rows[:, code == i].sum(1)
        totals[cam] = totals[cam] + own if cam in totals else own


def _start_pass(free: tuple[str, ...], s: Settings):
    n = len(free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each camera: cost (twice), views, and what its frames leave."""
        totals, kind = {}, None
        for whole in batches:
            kind = whole.column("cam_id").type
            for b in _slices(whole):
                views, blank, at, starts = _views(b)
                sums, seen = _view_sums(_pose(b, "rot", "loc"), _vectors(b, "now"), views, blank, at, starts, free, s)
                _add(totals, b.column("cam_id"), np.vstack([sums[-1], seen, _Eliminated(sums, _numbers(b.column("lam")), n).reduced()]))
        if totals:
            yield pa.RecordBatch.from_pydict({"cam_id": pa.array(list(totals), kind), "s": pa.array([list(x) for x in totals.values()], pa.list_(pa.float64()))})

    return run


def _round_pass(free: tuple[str, ...], s: Settings):
    n = len(free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frames with their accepted and their tried poses, then rows with the sums of each camera.

        The sums are those of the tried poses and cameras, and what frames leave if the step is taken, and if it is not.
        """
        totals, names, kinds = {}, ["frame_id", "cam_id", "rot", "loc", "rot1", "loc1", "views", "s"], None
        for whole in batches:
            for b in _slices(whole):
                took = b.column("took").to_numpy(zero_copy_only=False).astype(bool)
                pose = np.where(took, _pose(b, "rot1", "loc1"), _pose(b, "rot", "loc"))
                tried = pose.copy()
                live = b.column("live").to_numpy(zero_copy_only=False).astype(bool)
                if live.any():
                    d = b if live.all() else b.filter(pa.array(live))
                    views, blank, at, starts = _views(d)
                    old, lam = pose[:, live], _numbers(d.column("lam"))
                    sums, seen = _view_sums(old, _vectors(d, "now"), views, blank, at, starts, free, s)
                    step = np.where(seen > 0, _Eliminated(sums, lam, n).step(_vectors(d, "dc")), 0.0)
                    new = np.vstack([_composed(step[:3], old[:3]), old[3:] + step[3:]])
                    new = np.where(seen > 0, new, old)
                    tried[:, live] = new
                    refused = _Eliminated(sums, lam * 10, n).reduced()
                    sums, seen = _view_sums(new, _vectors(d, "next"), views, blank, at, starts, free, s)
                    taken = _Eliminated(sums, np.maximum(s.min_lam, lam / 3), n).reduced()
                    _add(totals, d.column("cam_id"), np.vstack([sums[-1], seen, taken, refused]))
                xyz = [pa.StructArray.from_arrays([pa.array(x) for x in p], names=list("xyz")) for p in (pose[:3], pose[3:], tried[:3], tried[3:])]
                out = [b.column("frame_id"), b.column("cam_id"), *xyz, b.column("views"), pa.nulls(b.num_rows, pa.list_(pa.float64()))]
                kinds = [x.type for x in out]
                yield pa.RecordBatch.from_arrays(out, names=names)
        if totals:
            size = len(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, kinds[0]), pa.array(list(totals), kinds[1]), *[pa.nulls(size, k) for k in kinds[2:7]],
                 pa.array([list(x) for x in totals.values()], kinds[7])], names=names)

    return run


def _by_frames(obs: DataFrame, poses: DataFrame, points: DataFrame, cams: DataFrame, free: tuple[str, ...], s: Settings) -> tuple[DataFrame, DataFrame, int]:
    """(state, poses, rounds): frames are written with their views once and go through the rounds one at a time.

    A round reads a frame, takes or drops the pose it tried last, tries the next one and writes it again with its views; nothing is joined but a few numbers of its camera, and only the last round's table stays.
    The tables ``obs`` and ``poses`` are deleted once the frames are written.
    """
    n, spark = len(free), obs.sparkSession
    size = n * n + 2 * n
    views = salted_lookup(obs, points, "kp_id", heavy=heavy_keys(obs, "kp_id")).where(" AND ".join(f"pt.{a} IS NOT NULL" for a in "xyz"))
    seen = written(views.select("frame_id", "u", "v", "pt.x", "pt.y", "pt.z"))
    discard(obs)
    free_shuffles(spark)
    views = seen.groupBy("frame_id").agg(F.collect_list(F.struct("u", "v", "x", "y", "z")).alias("views"))
    few = cams.count() <= FEW_CAMERAS
    heavy = [] if few else heavy_keys(poses, "cam_id")

    def with_cams(d: DataFrame, lookup: DataFrame, how: str = "inner") -> DataFrame:
        return d.join(F.broadcast(lookup), "cam_id", how) if few else salted_lookup(d, lookup, "cam_id", how, heavy)

    whole = F.expr(" AND ".join(f"{c}.{a} IS NOT NULL" for c in ("rot", "loc") for a in "xyz") + " AND views IS NOT NULL AND known")
    base = with_cams(poses.join(views, "frame_id", "left"), cams.select("cam_id", F.lit(True).alias("known")), "left")
    base = written(base.select("frame_id", "cam_id", "rot", "loc", "views", F.coalesce(whole, F.lit(False)).alias("part")))
    rest = written(base.where("NOT part").select("frame_id", "cam_id", "rot", "loc"))
    discard(seen)
    discard(poses)
    free_shuffles(spark)
    kinds = dict(base.dtypes)
    frames = base.where("part").select("frame_id", "cam_id", "rot", "loc", F.col("rot").alias("rot1"), F.col("loc").alias("loc1"), "views")

    def camera_columns(state: DataFrame) -> DataFrame:
        return state.select("cam_id", F.array(*PARAMETERS).alias("now"), "lam")

    def totals(d: DataFrame, width: int) -> DataFrame:
        parts = [F.sum(F.col("s")[i]) for i in range(width)]
        g = d.groupBy("cam_id").agg((0.5 * parts[0]).alias("new_cost"), parts[1].cast("long").alias("new_obs"), *[p.alias(f"r{i}") for i, p in enumerate(parts[2:])])
        return written(g.where("new_obs > 0").select("cam_id", "new_cost", "new_obs", F.array(*[f"r{i}" for i in range(width - 2)]).alias("r")))

    state = _start(cams, s)
    first = with_cams(frames, camera_columns(state)).select("cam_id", "rot", "loc", "views", "now", "lam")
    left = totals(first.mapInArrow(_start_pass(free, s), f"cam_id {kinds['cam_id']}, s array<double>"), 2 + size)
    state = _first_costs(state, left.select("cam_id", "new_cost", "new_obs"))
    took = state.select("cam_id", F.lit(False).alias("took"))
    rounds, kept = 0, base
    while rounds < s.max_iters and not state.where("NOT converged").isEmpty():
        rounds += 1
        damp = state.where("NOT converged").select("cam_id", "lam")
        step = written(damp.join(left.select("cam_id", "r"), "cam_id").select("cam_id", _solved(n)("r", "lam").alias("dc")))
        tried = _tried(state, step, free)
        own = camera_columns(state).join(tried.select("cam_id", F.array(*PARAMETERS).alias("next"), (~F.col("converged")).alias("live")), "cam_id")
        own = own.join(step, "cam_id", "left").join(took, "cam_id").withColumn("dc", F.coalesce("dc", F.array(*[F.lit(0.0)] * n)))
        d = with_cams(frames, written(own)).select("frame_id", "cam_id", "rot", "loc", "rot1", "loc1", "views", "now", "next", "dc", "lam", "took", "live")
        d = written(d.mapInArrow(_round_pass(free, s), _FRAME.format(f=kinds["frame_id"], c=kinds["cam_id"])), "frames")
        discard(kept)
        kept, frames = d, d.where("s IS NULL").drop("s")
        new = totals(d.where("s IS NOT NULL"), 2 + 2 * size)
        verdict = _verdict(tried.join(new.select("cam_id", "new_cost", "new_obs"), "cam_id", "left"), free, s)
        state = _next_state(state, verdict, free)
        took = verdict.select("cam_id", F.col("ok").alias("took"))
        left = written(new.join(took, "cam_id").select("cam_id", F.when(F.col("took"), F.slice("r", 1, size)).otherwise(F.slice("r", size + 1, size)).alias("r")))
        free_shuffles(spark)
    last = with_cams(frames, took).select("frame_id", "cam_id", *[F.when(F.col("took"), F.col(f"{c}1")).otherwise(F.col(c)).alias(c) for c in ("rot", "loc")])
    return state, last.unionByName(rest), rounds

def calibrate(obs: DataFrame, poses: DataFrame, points: DataFrame, cams: DataFrame, free: tuple[str, ...] = ("fx", "fy", "k1", "k2"),
              s: Settings | None = None) -> Calibration:
    """Free intrinsics of every camera and the poses of its frames, from views of known landmarks.

    ``obs``: frame_id, kp_id, u, v. ``poses``: frame_id, cam_id, rot, loc, where to start. ``points``: kp_id, pt. ``cams``: cam_id and PARAMETERS,
    where to start; those not in ``free`` stay. A camera is done when a step gains less than ftol of its cost or leaves less than EXACT_PX, or when no damping up to max_lam
    helps; cameras that are not done after max_iters rounds warn and have converged = false. Cameras and frames without views stay as they are.
    ``obs`` that ``written`` made are handed over: they are deleted once they and the other tables are read.
    """
    s, n = s or Settings(), len(free)
    if not n or set(free) - set(PARAMETERS):
        raise ValueError(f"free intrinsics are some of {PARAMETERS}")
    obs = obs if is_written(obs) else written(obs.select("frame_id", "kp_id", "u", "v"))
    free_shuffles(obs.sparkSession)
    points, cams = written(points.select("kp_id", "pt")), written(cams.select("cam_id", *PARAMETERS))
    poses = written(poses.select("frame_id", "cam_id", "rot", "loc"))
    free_shuffles(obs.sparkSession)
    most = obs.where("frame_id IS NOT NULL").groupBy("frame_id").count().agg(F.max("count")).first()[0] or 0
    state, poses, rounds = (_by_frames if most <= GATHERED else _by_rows)(obs, poses, points, cams, free, s)
    still = state.where("NOT converged").count()
    if still:
        warnings.warn(f"{still} cameras not calibrated to {s.ftol} after {rounds} rounds", RuntimeWarning, 2)
    rms = F.when(F.col("n_obs") > 0, F.sqrt(2 * F.col("cost") / F.col("n_obs")) * s.px_sd)
    return Calibration(state.select("cam_id", *PARAMETERS, "cost", "n_obs", rms.alias("rms_px"), "converged"), poses, rounds)
